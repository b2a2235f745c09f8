import random
import re
from collections import defaultdict

import numpy as np
import pytest

from riskfabric.llm import components, jaccard, neardup, queries

FOLDER = "/root/testdata/sf0.001"


def _roots(names, links):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def brute_jaccard(docs, width, num, den):
    lower, sets = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}), {}
    for key, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    seen, links = defaultdict(list), []
    for key in docs:
        common = defaultdict(int)
        for s in sets[key]:
            for other in seen[s]:
                common[other] += 1
            seen[s].append(key)
        links += [(key, o) for o, n in common.items() if den * n >= num * (len(sets[key]) + len(sets[o]) - n)]
    roots = _roots(docs, links)
    return {k: (len(sets[k]), roots[k]) for k in docs}


def test_components_of_random_edges(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == _roots({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op3_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, FOLDER).collect()}
    assert got == brute_jaccard(docs, 3, 90, 100)


@pytest.mark.parametrize("tree", [16, 1024])
def test_large_family_short_texts_and_edges(spark, tree):
    rnd, base, rows = random.Random(3), [f"w{i}" for i in range(120)], []
    for i in range(250):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i + 5, " ".join(w)))
    rows += [(1000 + i, rnd.choice(["a b", "A  B", "", None, "q", "a b c d", "A b\tC d"])) for i in range(40)] + [(2000, " ".join(base) * 60)]
    extra = [(None, "a b"), (None, "nobody else"), (1000, dict(rows)[1000])]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows + extra], "doc_id long, text string, band string, node int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_groups(table, width=3, share=(90, 100), tree=tree).collect()]
    want = brute_jaccard(dict(rows), 3, 90, 100)
    assert len(got) == len(rows) + 3
    assert all((n, c) == want[k] for k, n, c in got if k is not None)
    least = min((k for k, t in rows if t and t.lower().split() == ["a", "b"]), default=None)
    assert sorted(((n, c) for k, n, c in got if k is None), key=str) == sorted([(1, least), (1, None)], key=str)
    assert jaccard.ngram_groups(table.limit(0)).count() == 0


def test_tree_walk_loses_no_pair():
    rnd = np.random.default_rng(6)
    pool = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = rnd.choice(pool, rnd.integers(20, 200), replace=False)
        for _ in range(4):
            sets.append(np.unique(np.concatenate([own[rnd.random(len(own)) > 0.08], rnd.choice(pool, 3)])))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    assert len(links) > 50
    edges = jaccard.connect(sets, np.arange(len(sets)), (80, 100))
    assert _roots(range(len(sets)), edges) == _roots(range(len(sets)), links)
    across = jaccard.connect(sets, np.arange(len(sets)), (80, 100), split=100)
    assert _roots(range(len(sets)), across) == _roots(range(len(sets)), [(i, j) for i, j in links if (i < 100) != (j < 100)])


def brute_vectors(rows, threshold):
    unit = {}
    for at, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[at] = x / np.sqrt((x * x).sum())
    pairs = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    counts = defaultdict(int)
    for i, j in pairs:
        counts[i] += 1
        counts[j] += 1
    roots = _roots([k for k, _ in rows if k is not None], [(rows[i][0], rows[j][0]) for i, j in pairs if rows[i][0] is not None and rows[j][0] is not None])
    return [(k, counts[at], roots.get(k)) for at, (k, _) in enumerate(rows)]


def _near(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, blocks string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(table, **options).collect()), key=str)


def test_vectors_equal_brute_force_over_several_passes(spark):
    rnd = np.random.default_rng(8)
    centres, rows = rnd.standard_normal((60, 16)), []
    for i in range(500):
        rows.append((i + 1, (centres[i % 60] + (0.12 + 0.15 * rnd.random()) * rnd.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 0.0]), (2007, [2.0, 0.0]), (2007, [2.0, 0.0])]
    assert neardup.passes(540, 0.95, 64) > 3
    got = _near(spark, rows, block=64)
    assert got == sorted([(k, n, c, k == c) for k, n, c in brute_vectors(rows, 0.95)], key=str)


def test_dense_group_over_many_blocks(spark):
    rnd = np.random.default_rng(11)
    centre, rows = rnd.standard_normal(32), []
    for i in range(700):
        rows.append((i + 1, (centre + (0.17 if i % 7 else 0.24) * rnd.standard_normal(32)).astype(np.float32).tolist()))
    rows += [(1000 + i, rnd.standard_normal(32).astype(np.float32).tolist()) for i in range(700)] + [(3000, rows[0][1])] * 3
    want = brute_vectors(rows, 0.95)
    assert sum(n for _, n, _ in want) > 200_000
    got = _near(spark, rows, block=16)
    assert sum(r[1] for r in got) == sum(n for _, n, _ in want)
    assert got == sorted([(k, n, c, k == c) for k, n, c in want], key=str)
    assert _near(spark, rows, block=16, cell=100) == got


def test_vector_edges(spark):
    got = _near(spark, [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (9, [-1.0, 0.0])])
    assert got == sorted([(None, 1, 5, False), (5, 1, 5, True), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert _near(spark, []) == []
