"""Connected components of an edge table, and spanning stars of edges inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.session import cut_lineage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps, so long chains shorten by a constant factor each
    round. Every step reduces by a partial aggregate and joins back, so a node with very many
    edges is split by the adaptive join and never gathered. Each round is written to the shared
    folder; nothing but two checksums reaches the driver.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    stars = cut_lineage(stars, "stars")
    seen = None
    for _ in range(rounds):
        stars = cut_lineage(small_star(large_star(stars)), "stars")
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return stars.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)


def thinned(edges: DataFrame, held: int = 1 << 20) -> DataFrame:
    """Fewer edges (a, b) with the same components: each task hands on spanning stars of its own."""
    kind = edges.select("a", "b").schema
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        parts, n = [], 0

        def stars():
            u, v = spanning_stars(*(np.concatenate(x) for x in zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)

        for batch in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n > held:
                yield stars()
                parts, n = [], 0
        if n:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, kind)


def large_star(stars: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = stars.select(F.col("x").alias("u"), F.col("y").alias("v")).union(stars.select("y", "x"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()


def small_star(stars: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them."""
    least = stars.groupBy("x").agg(F.min("y").alias("m"))
    moved = stars.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.union(least.select("x", F.col("m").alias("y"))).distinct()


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node with the same components as the edges (u, v)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    hang = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[hang]], nodes[hang]
