"""Similarity join on word n-grams with signature trees.

Texts of equal shingle sets are one class. Classes that agree in a band of minimum hashes share the root of a tree; so many bands are kept that a pair at
the threshold misses all of them with a probability of 1e-12, the order of a hash collision, and pairs above it with less. A tree's leaves are sets as token bitmaps;
a node holds the OR of its children's bitmaps, the range of their sizes and how many shingles share a bit at most. A tree is joined with itself, or with another, by
walking both at once: a pair of nodes is left where the sizes, or the most its sets can have in common by the bits that both bitmaps hold, rule out the
threshold, or where all of it is connected already. The pairs of leaves that remain are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm import words
from riskfabric.llm.components import Forest, components, groups
from riskfabric.llm.shared import release, written

#: Chance to miss a pair at the threshold, hashes in a band, children of a node, and classes in one tree.
MISS, ROWS, FANOUT, TREE = 1e-12, 5, 8, 1024


def bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of `rows` minimum hashes of which a pair at the threshold shares one but for the chance `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def band_keys(items: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Keys of the bands of a set of 64-bit hashes."""
    numbers = words.mix64(np.arange(1, 2 * count * rows + 1, dtype=np.uint64))
    factors, shifts = numbers[0::2] | np.uint64(1), numbers[1::2]
    least = np.full(count * rows, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(items), 4096):
        np.minimum(least, (factors[:, None] * items[None, low : low + 4096] + shifts[:, None]).min(axis=1), out=least)
    weights = words.mix64(np.arange(rows, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    return words.mix64((least.reshape(count, rows) * weights).sum(axis=1, dtype=np.uint64) + np.arange(count, dtype=np.uint64)).view(np.int64)


class Tree:
    """Signature tree of sets (sorted arrays of hashes); level 0 are the sets in tree order."""

    def __init__(self, sets: list[np.ndarray], bits: int, labels: np.ndarray):
        first = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
        sizes = np.array([len(s) for s in sets])
        self.order = np.lexsort((sizes, first))
        low = sizes[self.order]
        maps = np.empty((len(sets), bits // 64), dtype=np.uint64)
        for i, at in enumerate(self.order):
            flags = np.zeros(bits, dtype=bool)
            flags[(sets[at] >> np.uint64(17)).astype(np.int64) & (bits - 1)] = True
            maps[i] = np.packbits(flags).view(np.uint64)
        shared = low - np.bitwise_count(maps).sum(axis=1)
        tags = labels[self.order]
        self.levels = [(maps, low, low, shared, tags)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, shared, tags = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            same = np.minimum.reduceat(tags, at) == np.maximum.reduceat(tags, at)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(shared, at), np.where(same, tags[at], -1)))


def _children(parents: np.ndarray, count: int) -> np.ndarray:
    return np.minimum(parents[:, None] * FANOUT + np.arange(FANOUT), count)


def candidates(left: Tree, right: Tree | None, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that walking both trees leaves, in slices; with right None those of the tree itself, once each."""
    own, other = right is None, right or left
    num, den = share

    def walk(a: int, b: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(i), 8192):
            x, y = i[low : low + 8192], j[low : low + 8192]
            (maps_x, low_x, high_x, shared_x, tag_x), (maps_y, low_y, high_y, shared_y, tag_y) = left.levels[a], other.levels[b]
            keep = (den * high_x[x] >= num * low_y[y]) & (den * high_y[y] >= num * low_x[x]) & ((tag_x[x] == -1) | (tag_x[x] != tag_y[y]))
            x, y = x[keep], y[keep]
            most = np.bitwise_count(maps_x[x] & maps_y[y]).sum(axis=1) + np.minimum(shared_x[x], shared_y[y])
            keep = (num + den) * most >= num * (low_x[x] + low_y[y])  # den * common >= num * (|A| + |B| - common)
            x, y = x[keep], y[keep]
            if a == 0 and b == 0:
                keep = x < y if own else np.ones(len(x), bool)
                if keep.any():
                    yield x[keep], y[keep]
                continue
            down_a, down_b = max(a - 1, 0), max(b - 1, 0)
            cx = _children(x, len(left.levels[down_a][1])) if a else x[:, None]
            cy = _children(y, len(other.levels[down_b][1])) if b else y[:, None]
            gx, gy = np.repeat(cx, cy.shape[1], axis=1).ravel(), np.tile(cy, (1, cx.shape[1])).ravel()
            real = (gx < len(left.levels[down_a][1])) & (gy < len(other.levels[down_b][1]))
            if own:
                real &= gx <= gy
            yield from walk(down_a, down_b, gx[real], gy[real])

    yield from walk(len(left.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def connect(sets: list[np.ndarray], labels: np.ndarray, share: tuple[int, int], split: int | None = None) -> list[tuple[int, int]]:
    """Linking pairs of positions that connect all sets which links connect. With `split` only sets before it are compared with those from it on."""
    num, den = share
    bits = 1 << max(8, int(np.ceil(np.log2(4 * max(len(s) for s in sets)))))
    if split is None:
        left, right = Tree(sets, bits, labels), None
        first, second = left.order, left.order
    else:
        left, right = Tree(sets[:split], bits, labels[:split]), Tree(sets[split:], bits, labels[split:])
        first, second = left.order, right.order + split
    forest = Forest(labels)
    for x, y in candidates(left, right, share):
        a, b = first[x], second[y]
        open_pairs = forest.apart(a, b)
        for p, q in zip(a[open_pairs].tolist(), b[open_pairs].tolist()):
            if forest.label[p] != forest.label[q]:
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if den * common >= num * (len(sets[p]) + len(sets[q]) - common):
                    forest.join(p, q)
    return forest.edges


def features(documents: DataFrame, key: str, text: str, width: int, threshold: float, rows: int) -> DataFrame:
    """key, n_shingles, digest of the set (none for an empty one) and band keys of every row."""
    count = bands(threshold, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part, sizes, digests, keys = batch.slice(low, 1024), [], [], []
                with np.errstate(over="ignore"):
                    for items in words.sets(part.column(1), width):
                        sizes.append(len(items))
                        digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                        keys.append(band_keys(items, count, rows) if len(items) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                                 names=["key", "n", "digest", "bands"])
        release()

    return documents.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, n long, digest binary, bands array<long>")


def _joined(rows: DataFrame, keys: list[str], share: tuple[int, int], width: int) -> DataFrame:
    """Edges (a, b) of each group of rows (group columns, side, label, node, text); with rows of both sides only pairs across are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(keys)):
            side, label, node = (group.column(c).to_numpy() for c in ("side", "label", "node"))
            if len(node) < 2 or (label == label[0]).all():
                continue
            label = np.unique(label, return_inverse=True)[1]
            sets = [s for chunk in group.column("text").chunks for s in words.sets(chunk, width)]
            split = int((side == 0).sum()) if side[-1] else None
            edges = connect(sets, label, share, split) if split != 0 else []
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
        release()

    return rows.select(*keys, "side", "label", "node", "text").repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long")


def ngram_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, share: tuple[int, int] = (90, 100), rows: int = ROWS,
                 tree: int = TREE) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach, its own included) of every row.

    Texts link when `share[1]` * common shingles >= `share[0]` * all shingles of both. Words are runs of other characters than ASCII white space, with A-Z in lower
    case; a text of fewer words than `width` has one shingle of all of them. A missing or empty text has none and links with nothing. Rows of one key count as
    one node; a row without a key belongs to the component of texts of its set, if such have keys. Other columns are not read; an empty table gives no rows.

    Classes are found by a digest with partial aggregation, so copies are never paired. A root with more than `tree` classes is split into trees by hash, each with the
    root's smallest class in it; what those leave apart is then compared across the trees, the largest connected part as one side only.
    """
    threshold = share[0] / share[1]
    rows_of = written(features(documents, key, text, width, threshold, rows), "features")
    classes = rows_of.where("n > 0").groupBy("digest").agg(F.min("key").alias("node"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    keyed = classes.where("node IS NOT NULL").select("node", F.explode("bands").alias("band"))
    roots = keyed.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("_last")).where("root != _last").drop("_last")
    members = keyed.join(roots, "band").select("root", "node").distinct()
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("trees"))
    members = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
    members = written(members, "members")
    # Members are a share of all documents: nothing bounds them for a broadcast, so texts and members are sorted and merged at every size.
    texts = documents.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where(F.col("node").isNotNull()).hint("merge")

    everywhere = F.when((F.col("root") == F.col("node")) & (F.col("trees") > 1), F.sequence(F.lit(0), F.col("trees") - 1)).otherwise(F.array("part"))
    first = members.withColumn("part", F.explode(everywhere)).join(texts, "node").select(
        "root", F.col("part").cast("long").alias("part"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "text")
    edges = written(_joined(first, ["root", "part"], share, width), "links")

    split = members.where("trees > 1")
    if not split.isEmpty():
        edges = written(edges.unionByName(_across(split, texts, edges, share, width, tree)), "links")
    # A node with several texts (repeated keys) connects their classes by being one node.
    same = components(edges)
    named = classes.join(same, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return rows_of.drop("bands").join(named, "digest", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _across(split: DataFrame, texts: DataFrame, edges: DataFrame, share: tuple[int, int], width: int, tree: int) -> DataFrame:
    """Edges between the trees of split roots: classes outside a root's largest connected part against all classes of the root."""
    labelled = split.join(components(edges), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    parts = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    roots = parts.groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    roots = roots.where("all > most").withColumn("others", F.ceil((F.col("all") - F.col("most")) / tree).cast("int"))
    rows = labelled.join(roots, "root")
    cell = lambda n: F.sequence(F.lit(0), n - 1)
    outside = rows.where("label != main").withColumn("x", F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int")).withColumn("y", F.explode(cell(F.col("trees")))).withColumn("side", F.lit(0))
    inside = rows.withColumn("y", F.col("part")).withColumn("x", F.explode(cell(F.col("others")))).withColumn("side", F.lit(1))
    both = outside.select("root", "x", "y", "side", "label", "node").unionByName(inside.select("root", "x", "y", "side", "label", "node"))
    both = both.withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))
    return _joined(both.join(texts, "node"), ["root", "x", "y"], share, width)
