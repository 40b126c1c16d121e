"""Connected components by alternating large-star and small-star.

Large-star links every larger neighbour of a node to the node's smallest neighbour; small-star does so for a node's
smaller neighbours and the node itself. Both take the smallest neighbour by an aggregate that combines before the
shuffle; it is written and joined back, so that the join's exchanges are plain ones which adaptive execution splits when
one node has very many neighbours. Ends when a round changes no edge. No node or edge goes to the driver.

Before the first round each task contracts the edges that it holds, a bounded number, to stars of their own, which
connect the same nodes. That leaves fewer edges and shorter paths for the rounds, whose number grows with the logarithm
of the longest path; more than `most_rounds` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace


def _facts(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def _large_star(work: Workspace, edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    out = work.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
    work.drop(least)
    return out


def _small_star(work: Workspace, edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = work.write(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    out = work.write(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    work.drop(least)
    return out


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that these edges connect it with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # every node points to its root
            up = root[root]
            if (up == root).all():
                break
            root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def contract(part_edges: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solved():
            u, v = stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            for k in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= part_edges:
                yield from solved()
                held, n = [], 0
        if n:
            yield from solved()

    return run


def components(work: Workspace, edges: DataFrame, most_rounds: int = 60, part_edges: int = 1_000_000) -> DataFrame:
    """node and root (the smallest node of its component) for every node that has an edge to another; edges: u, v."""
    some = work.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    parts = max(1, -(-some.count() // part_edges))
    held = work.write(some.coalesce(parts).mapInArrow(contract(part_edges), "u long, v long"), "contracted")
    work.drop(some)
    facts = _facts(held)
    for _ in range(most_rounds):
        if not facts[0]:
            break
        large = _large_star(work, held)
        small = _small_star(work, large)
        work.drop(large, held)
        held, before, facts = small, facts, _facts(small)
        if facts == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
