"""Embedding near-duplicates by sorted projection passes.

A pass hashes every vector with random hyperplanes, concatenates the bits, and sorts all vectors by them; those close in that order are compared. Vectors are dealt
into blocks of the order, and a block is compared with itself and the block before it, so every vector meets a window of at least one block on either side. Where codes
that start with the same bits fill more blocks than a window has, the rows outside the largest connected part of that range are compared with all of it, in cells. So
a pair is missed only if it differs in those first bits in every pass, however densely vectors lie. Passes find what connects; links are then counted inside the
components, all vectors of one with each other in cells that give a number per vector and no pairs. Equal vectors are one class with a count, so copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfabric.llm.components import Forest, components, groups
from riskfabric.llm.shared import written

#: Vectors in a block and in a side of a cell, bits of a hash, and the chance that no pass brings a pair at the threshold together.
BLOCK, CELL, BITS, MISS = 512, 2048, 62, 1e-7


def leading(vectors: int, block: int = BLOCK) -> int:
    """Leading bits of a code that cut a table of so many distinct vectors down to a block, were they spread evenly."""
    return min(BITS, math.ceil(max(0.0, math.log2(max(vectors, 1) / block))))


def passes(vectors: int, threshold: float, block: int = BLOCK, miss: float = MISS) -> int:
    """Passes that a table of so many distinct vectors needs: a pair meets in a pass if it agrees in the leading bits."""
    agree = 1 - math.acos(threshold) / math.pi
    close = agree ** leading(vectors, block)
    return 1 if close >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-close))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hashes(classes: DataFrame, count: int, seed: int) -> DataFrame:
    """(node, sig, pass, code): the concatenated bits of every pass as one number that sorts like them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                vectors = part.column(2).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((size, count * BITS))
                    bits = (np.array([vectors[i] for i in at], dtype=np.float64) @ planes[size]).reshape(len(at), count, BITS) > 0
                    codes = (bits * weights).sum(axis=2)
                    node, sig = (part.column(c).take(pa.array(np.repeat(at, count))) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([node, sig, pa.array(np.tile(np.arange(count), len(at))), pa.array(codes.ravel())], names=["node", "sig", "pass", "code"])

    return classes.select("node", "sig", "vector").mapInArrow(run, "node long, sig long, pass long, code long")


def _ranked(codes: DataFrame, count: int) -> DataFrame:
    """Codes with their place in the order of their pass. Partitions of the sorted table number their own rows; their sizes (a row each) give the rest."""
    order = ["pass", "code", "node", "sig"]
    placed = written(codes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(sizes), "_part").withColumn("place", F.col("_base") + F.col("_at") - F.col("pass") * F.lit(count)).drop("_part", "_at", "_base")


def _units(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the vectors of each length."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        unit = flat[starts[at][:, None] + np.arange(size)]
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        yield at, unit


def _edges(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Edges (a, b) that connect what is linked in each group of rows (key columns, main, label, node, vector): main rows are compared with all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(keys)):
            main, label, node = (group.column(c).to_numpy(zero_copy_only=False) for c in ("main", "label", "node"))
            if not main.any() or (label == label[0]).all():
                continue
            forest = Forest(label)
            for at, unit in _units(group.column("vector")):
                new = np.flatnonzero(main[at])
                for low in range(0, len(new), 256):
                    own = new[low : low + 256]
                    x, y = np.nonzero(unit[own] @ unit.T >= threshold)
                    x, y = at[own[x]], at[y]
                    keep = forest.apart(x, y)
                    x, y = x[keep], y[keep]
                    for i in np.unique(x):
                        near = y[x == i]
                        while len(near := near[forest.apart(near, i)]):
                            forest.join(i, near[0])
            if forest.edges:
                a, b = np.array(forest.edges, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])

    return rows.select(*keys, "main", "label", "node", "vector").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _across(wide: DataFrame, full: DataFrame, threshold: float, cell: int) -> DataFrame:
    """Edges inside ranges (pass, range, node, sig, label): rows outside a range's largest connected part against all rows of the range."""
    parts = wide.groupBy("pass", "range", "label").agg(F.count(F.lit(1)).alias("n"))
    ranges = parts.groupBy("pass", "range").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    ranges = ranges.withColumn("trees", F.ceil(F.col("all") / cell)).withColumn("others", F.ceil((F.col("all") - F.col("most")) / cell))
    rows = wide.join(ranges, ["pass", "range"])
    turn = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = rows.where("label != largest").withColumn("x", F.pmod(F.xxhash64("node", "sig", F.lit(1)), "others")).withColumn("y", turn("trees")).withColumn("main", F.lit(True))
    inside = rows.withColumn("y", F.pmod(F.xxhash64("node", "sig"), "trees")).withColumn("x", turn("others")).withColumn("main", F.lit(False))
    keys = ["pass", "range", "x", "y"]
    both = outside.select(*keys, "main", "label", "node", "sig").unionByName(inside.select(*keys, "main", "label", "node", "sig"))
    return _edges(both.join(full, ["node", "sig"]), keys, threshold)


def _counted(rows: DataFrame, threshold: float, cell: int) -> DataFrame:
    """(node, sig, links) by cell of the classes (label, node, sig, vector, copies): links, in copies, with all other classes of the label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            part, copies, node, sig = (group.column(c).to_numpy(zero_copy_only=False) for c in ("part", "copies", "node", "sig"))
            within, links = group.column("x")[0].as_py() == group.column("y")[0].as_py(), np.zeros(len(node))
            for at, unit in _units(group.column("vector")):
                first = np.flatnonzero(part[at] == group.column("x")[0].as_py())
                second = first if within else np.flatnonzero(part[at] != group.column("x")[0].as_py())
                for low in range(0, len(first), 256):
                    own = first[low : low + 256]
                    hits = unit[own] @ unit[second].T >= threshold
                    if within:
                        hits[np.arange(len(own)), low + np.arange(len(own))] = False
                    hits = hits.astype(np.float64)
                    links[at[own]] += hits @ copies[at[second]]
                    if not within:
                        links[at[second]] += copies[at[own]] @ hits
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some], pa.int64()), pa.array(sig[some], pa.int64()), pa.array(links[some].astype(np.int64))], names=["node", "sig", "links"])

    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", F.ceil(F.col("n") / cell).alias("cells"))
    dealt = rows.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("node", "sig"), "cells"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).withColumn("x", F.least("part", "_other")).withColumn("y", F.greatest("part", "_other"))
    order = ["label", "x", "y"]
    return dealt.select(*order, "part", "copies", "node", "sig", "vector").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "node long, sig long, links long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block: int = BLOCK, miss: float = MISS, seed: int = 5,
                    cell: int = CELL) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Vectors link at a cosine of at least `threshold` in double precision; only vectors of equal length are compared. A vector that is missing, empty, zero or holds a
    missing or non-finite component links with nothing. Repeated rows are further vectors; rows of one key are one node of the components. A row without a key is linked
    and counted, and takes the component of the keys it reaches, or none. `kept` marks the row whose key is its component's (a row without a component is kept).
    Other columns are not read; an empty table gives no rows.
    """
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    usable = rows.where(_usable(F.col("vector")))
    classes = usable.groupBy("vector").agg(F.min("key").alias("_least"), F.count(F.lit(1)).alias("copies")).withColumn("sig", F.xxhash64("vector"))
    classes = written(classes.withColumn("node", F.coalesce("_least", F.lit(-(1 << 62)) - F.abs(F.col("sig") % (1 << 40)))), "classes")
    count = classes.count()
    turns = passes(count, threshold, block, miss)
    ranked = _ranked(_hashes(classes, turns, seed), count).withColumn("block", F.floor(F.col("place") / block).cast("int"))
    ranked = ranked.withColumn("range", F.shiftright("code", BITS - leading(count, block))).select("node", "sig", F.col("pass").cast("long").alias("pass"), "block", "range")
    ranked = written(ranked, "ranked")
    full = classes.select("node", "sig", "vector")
    spread = ranked.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("main")).withColumn("block", (F.col("block") + (~F.col("main")).cast("int")).cast("long"))
    row_label = F.xxhash64("node", "sig").alias("label")
    found = written(_edges(spread.select("*", row_label).join(full, ["node", "sig"]), ["pass", "block"], threshold), "links")
    # Ranges of more than two blocks hold pairs that no window brings together.
    wide = ranked.groupBy("pass", "range").agg((F.max("block") - F.min("block")).alias("_span")).where("_span > 1").select("pass", "range")
    if not wide.isEmpty():
        labelled = ranked.join(wide, ["pass", "range"]).join(components(found), "node", "left").select("pass", "range", "node", "sig", F.coalesce("component", "node").alias("label"))
        found = written(found.unionByName(_across(labelled, full, threshold, cell)), "links")
    same = components(found)
    counts = _counted(classes.join(same, "node", "left").withColumn("label", F.coalesce("component", "node")), threshold, cell)
    linked = written(counts, "counts").groupBy("node", "sig").agg(F.sum("links").alias("links"))
    # A node that stands for rows without a key may connect others, but never names a component while another node can.
    real = same.where(f"node > {-(1 << 61)}").groupBy("component").agg(F.min("node").alias("name"))
    named = same.join(real, "component", "left").select("node", "name")
    result = classes.join(linked, ["node", "sig"], "left").join(named, "node", "left").select(
        "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("name", "_least").alias("name"))
    good = rows.join(result, "vector", "left")
    component = F.coalesce("name", "key")
    return good.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("key") == component, component.isNull()).alias("kept"))
