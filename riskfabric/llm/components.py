"""Connected components of an edge table, and groups of rows inside sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours of a node go to the smallest node around it; small star: the node and its smaller neighbours do."""
    around = edges if small else _both(edges)
    least = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    moved = around.join(least, "a")
    if small:
        pairs = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    else:
        pairs = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pairs.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (a, b); the component is the smallest node. Alternating stars until nothing moves.

    Edges without both ends and loops mean nothing. Every round is written to the shared folder; the driver sees a count and a checksum only.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        edges = written(_stars(_stars(edges, small=False), small=True), "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of equal leading columns (whole numbers), which a sorted partition holds one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            name = tuple(columns[:, low].tolist())
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Components of one task's rows while pairs are found: `label` is equal for rows that are connected."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()
        self.edges: list[tuple[int, int]] = []

    def apart(self, a, b):
        return self.label[a] != self.label[b]

    def join(self, a: int, b: int) -> None:
        if self.label[a] != self.label[b]:
            self.edges.append((a, b))
            self.label[self.label == self.label[b]] = self.label[a]
