"""Connected components by alternating large-star and small-star steps over DataFrames.

Every step is a minimum per node and a join.  The minima are pre-aggregated before the shuffle and
written down, so both sides of the join have exchanges of their own and adaptive execution can split
a hot node's partition.  The links are written to shared storage after each round too, so lineage stays
short and a lost executor costs no more than a round.  As soon as no more than ``TASK_LINKS`` links are
left, one task finishes them; it holds 16 bytes a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shelf

#: Links that one task may finish.
TASK_LINKS = 500_000


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of all nodes of the links, by hooking roots to smaller ones and halving paths."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, low = x[apart], y[apart], np.minimum(rx, ry)[apart]
        np.minimum.at(root, rx[apart], low)
        np.minimum.at(root, ry[apart], low)
        while len(x) and (root != (up := root[root])).any():
            root = up
    while (root != (up := root[root])).any():
        root = up
    return nodes, nodes[root]


def _finished(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            node, component = folded(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())})

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def _stars(links: DataFrame, shelf: Shelf) -> DataFrame:
    """Connects every greater neighbour of a node to its smallest neighbour, itself included."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = shelf.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = shelf.put(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
    shelf.drop(least)
    return out


def _fold(links: DataFrame, shelf: Shelf) -> DataFrame:
    """Connects every smaller neighbour of a node, and the node, to the smallest one."""
    least = shelf.put(links.groupBy("a").agg(F.min("b").alias("m")))
    others = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = shelf.put(others.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    shelf.drop(least)
    return out


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) of all nodes with links (a, b); a component's id is its smallest node."""
    now = shelf.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    digest = None
    while True:
        if now.count() <= TASK_LINKS:
            return _finished(now)
        stars = _stars(now, shelf)
        shelf.drop(now)
        now = _fold(stars, shelf)
        shelf.drop(stars)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == digest:
            break
        digest = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
