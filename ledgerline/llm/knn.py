"""Operator 9: exact top-k search by a Voronoi kNN join.

Vectors are turned into integers and lifted by one coordinate, sqrt(M^2 - |x|^2) for data and 0 for queries, so that
the largest inner products are the smallest Euclidean distances. Pivots divide the lifted space into Voronoi cells; a
row is placed by the coarse pivots first and then by those near its coarse one. Cell summaries (the k+1 smallest
distances to the pivot, a histogram of all, the largest of queries) give every query cell a bound on its k-th distance;
by the triangle inequality only data whose distance to its own pivot lies in an interval can matter to it. Query cells
are put together into groups of bounded size, cells with more queries are split over several groups, and the necessary
data are copied, as packed blocks, to each group and one of its slices. A group has as many slices as the histograms
say that it needs data, and its queries go to those only. Groups are solved locally and their partial results merged.

Pivots are about the square root of the rows, `max_pivots` at most: the driver holds a table of pivots x pivots and 64
histogram numbers for each, never anything else that grows with the rows. Groups and slices are bounded in rows and in
bytes. A cell with a large share of all rows is spread over slices, which are dealt by block and not by cell.

Inner products are taken in floating point where the largest query and the largest datum of a slice prove that every
partial sum is an exact integer, else in 64-bit integers.

Defined results: vectors that are null, or hold null, NaN or infinite components, and rows without an id take no part.
Rows that repeat an id are queries each, and candidates of all but themselves. A shorter vector is filled up with
zeros; an empty one is all zeros. Scores must fit in 64 bits. Ties go to the smaller id. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace

ASSIGNED = "vec_id long, vec binary, cell int, dist double, qcell int, qdist double, row long"
BINS = 64


def integers(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, floor(scale * x) and a number of every row that takes part."""
    v = F.col("e")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
        .select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.monotonically_increasing_id().alias("row"))
    )


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as a matrix, filled up with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == n * dim and (lengths == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    mask = np.arange(dim) < lengths[:, None]
    out[mask] = flat
    return out


def lifted_distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1) + lift * lift
    psq = (pivots * pivots).sum(1) + pivot_lift * pivot_lift
    return np.sqrt(np.maximum(0, sq[:, None] + psq - 2 * (x @ pivots.T + np.outer(lift, pivot_lift))))


def nearest(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray, coarse: int, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and its distance to the cell's pivot: the nearest coarse pivot, then the nearest of its members."""
    top = lifted_distances(x, lift, pivots[:coarse], pivot_lift[:coarse]).argmin(1)
    cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    order = np.argsort(top, kind="stable")
    cuts = np.searchsorted(top[order], np.arange(coarse + 1))
    for c in range(coarse):
        i = order[cuts[c] : cuts[c + 1]]
        if len(i):
            d = lifted_distances(x[i], lift[i], pivots[members[c]], pivot_lift[members[c]])
            k = d.argmin(1)
            cell[i], dist[i] = members[c][k], d[np.arange(len(i)), k]
    return cell, dist


def assigner(pivots: np.ndarray, pivot_lift: np.ndarray, top: float, dim: int, query_mod: int):
    coarse = max(1, int(len(pivots) ** 0.5))
    home = lifted_distances(pivots, pivot_lift, pivots[:coarse], pivot_lift[:coarse]).argmin(1)
    home[:coarse] = np.arange(coarse)
    members = [np.flatnonzero(home == c) for c in range(coarse)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                m = matrix(batch.column(1), dim)
                x = m.astype(np.float64)
                cell, dist = nearest(x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1))), pivots, pivot_lift, coarse, members)
                asks = np.flatnonzero(ids % query_mod == 0)
                qcell, qdist = np.full(len(x), -1, np.int64), np.zeros(len(x))
                qcell[asks], qdist[asks] = nearest(x[asks], np.zeros(len(asks)), pivots, pivot_lift, coarse, members)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([r.tobytes() for r in np.ascontiguousarray(m, np.int64)], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(qcell.astype(np.int32)), pa.array(qdist), batch.column(2)],
                    names=["vec_id", "vec", "cell", "dist", "qcell", "qdist", "row"],
                )

    return run


def top_k(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the columns of its k best by (score, smaller id), without the query's own row. ids ascend."""
    n = scores.shape[1]
    for q in range(len(scores)):
        s = scores[q]
        keep = min(n, k + 1)
        if n > keep:
            least = np.partition(s, n - keep)[n - keep]
            cols = np.concatenate([np.flatnonzero(s > least), np.flatnonzero(s == least)[:keep]])
        else:
            cols = np.arange(n)
        cols = cols[rows[cols] != own[q]]
        yield q, cols[np.lexsort((ids[cols], -s[cols]))][:k]


def products(q: np.ndarray, x: np.ndarray, floats: np.ndarray | None) -> np.ndarray:
    """Inner products of integer vectors; floats: x as such, or None where x alone forbids them."""
    largest = [float(max(np.abs(v).max(initial=0), 1)) for v in (q, x)]
    if floats is not None and q.shape[1] * largest[0] * largest[1] < 2**52:
        return (q.astype(np.float64) @ floats.T).astype(np.int64)
    return q @ x.T


def solver(between, reach, dim: int, k: int):
    """Solves one group and slice: its queries against its data blocks, each query cell against the data it needs."""

    def run(left, right):
        import pandas as pd

        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, rows = (np.concatenate([np.frombuffer(b, np.int64) for b in right[c]]) for c in ("ids", "rows"))
            data = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, dim) for b in right["vecs"]]) if dim else np.zeros((len(ids), 0), np.int64)
            cells = np.concatenate([np.frombuffer(b, np.int32) for b in right["cells"]])
            dist = np.concatenate([np.frombuffer(b, np.float64) for b in right["dists"]])
            order = np.argsort(ids, kind="stable")
            ids, rows, data, cells, dist = ids[order], rows[order], data[order], cells[order], dist[order]
            floats = data.astype(np.float64) if dim * float(max(np.abs(data).max(initial=0), 1)) < 2**52 else None
            for qcell, part in left.groupby("qcell"):
                need = np.abs(dist - between.value[qcell][cells]) <= reach[qcell]
                if not need.any():
                    continue
                some, some_ids, some_rows = data[need], ids[need], rows[need]
                some_floats = floats[need] if floats is not None else None
                for a in range(0, len(part), 256):
                    p = part.iloc[a : a + 256]
                    q = np.stack([np.frombuffer(b, np.int64) for b in p["vec"]])
                    own_ids, own = p["vec_id"].to_numpy(), p["row"].to_numpy()
                    scores = products(q, some, some_floats)
                    for i, cols in top_k(scores, some_ids, some_rows, own, k):
                        out["query_row"] += [own[i]] * len(cols)
                        out["query_id"] += [own_ids[i]] * len(cols)
                        out["vec_id"] += some_ids[cols].tolist()
                        out["score"] += scores[i, cols].tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def knn_join(
    spark: SparkSession, vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, max_pivots: int = 2048,
    group_queries: int = 8192, slice_rows: int = 16_384, block_bytes: int = 32 << 20, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates with the largest inner product for each query."""
    work = Workspace(spark, "knn")
    v = work.write(integers(vectors, scale, vec_id, embedding), "integers")
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"]:
        return empty
    n, dim, top = facts["n"], facts["dim"], float(facts["top"]) ** 0.5 * (1 + 1e-12)
    fits = max(256, block_bytes // (8 * max(1, dim)))
    group_queries, slice_rows = min(group_queries, fits), min(slice_rows, fits)

    # pivots: the rows of the smallest hashes among about four times as many
    n_pivots = int(min(max_pivots, max(1, n**0.5)))
    drawn = v.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(max(1, n // (4 * n_pivots)))) == 0)
    picked = drawn.orderBy(F.xxhash64("row"), "row").limit(n_pivots).collect() or v.limit(1).collect()
    pivots = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        pivots[i, : len(r["v"])] = r["v"]
    pivot_lift = np.sqrt(np.maximum(0, top * top - (pivots * pivots).sum(1)))

    assigned = work.write(v.select("vec_id", "v", "row").mapInArrow(assigner(pivots, pivot_lift, top, dim, query_mod), ASSIGNED), "assigned")
    work.drop(v)

    # summaries: at most k + 1 + BINS + 2 numbers for each of at most max_pivots cells
    closest = assigned.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist")).alias("i")).where(F.col("i") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in closest.collect():
        near.setdefault(r["cell"], []).append(r["dist"])
    P, width = len(picked), 2 * (top + 1) / BINS
    histogram = np.zeros((P, BINS))
    for r in assigned.groupBy("cell", F.least(F.floor(F.col("dist") / F.lit(width)), F.lit(BINS - 1)).alias("bin")).count().collect():
        histogram[r["cell"], r["bin"]] += r["count"]
    queries = assigned.where("qcell >= 0").groupBy("qcell").agg(F.count(F.lit(1)).alias("n"), F.max("qdist").alias("far")).collect()
    if not queries:
        return empty
    between = lifted_distances(pivots, pivot_lift, pivots, pivot_lift)
    slack = 1e-6 * (1 + top)
    reach = np.zeros(P)
    near_cells = np.concatenate([np.full(len(d), s) for s, d in near.items()])
    near_dists = np.concatenate([np.array(d) for d in near.values()])
    for r in queries:
        c, far = r["qcell"], r["far"]
        upper = far + between[c, near_cells] + near_dists
        bound = np.partition(upper, k)[k] if len(upper) > k else np.inf
        reach[c] = far + bound + slack

    # groups of query cells: first id, number of groups and class of each cell; a class has the cells that share groups
    first, many, kind = np.zeros(P, np.int64), np.zeros(P, np.int64), np.zeros(P, np.int64)
    group = klass = held = 0
    for r in sorted(queries, key=lambda r: (between[0, r["qcell"]], r["qcell"])):
        c, m = r["qcell"], r["n"]
        if held and held + m > group_queries:
            group, klass, held = group + 1, klass + 1, 0
        first[c], kind[c] = group, klass
        if m > group_queries:
            many[c] = -(-m // group_queries)
            group, klass, held = group + many[c], klass + 1, 0
        else:
            many[c], held = 1, held + m
    n_class = klass + (1 if held else 0)
    class_lo, class_hi = np.full((n_class, P), np.inf), np.full((n_class, P), -np.inf)
    class_first, class_many, class_slices = np.zeros(n_class, np.int64), np.ones(n_class, np.int64), np.ones(n_class, np.int64)
    for r in queries:
        c = r["qcell"]
        class_lo[kind[c]] = np.minimum(class_lo[kind[c]], between[c] - reach[c])
        class_hi[kind[c]] = np.maximum(class_hi[kind[c]], between[c] + reach[c])
        class_first[kind[c]], class_many[kind[c]] = first[c], many[c]
    edge = np.arange(BINS) * width
    last = np.append(edge[1:], np.inf)
    for c in range(n_class):
        needed = histogram[(last >= class_lo[c][:, None]) & (edge <= class_hi[c][:, None])].sum()
        class_slices[c] = max(1, -(-int(needed) // slice_rows))
    intervals = spark.sparkContext.broadcast((class_lo, class_hi))  # n_class x P numbers each, both at most max_pivots
    shared_between = spark.sparkContext.broadcast(between)

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() * 7919
        lows, highs = intervals.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                ids, row = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                vecs = np.array(batch.column(1).to_pylist(), object)
                cells, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                count += 1
                rows: list[list] = [[] for _ in range(7)]
                for c in range(n_class):
                    need = (dist >= lows[c][cells]) & (dist <= highs[c][cells])
                    if not need.any():
                        continue
                    packed = ids[need].tobytes(), row[need].tobytes(), b"".join(vecs[need]), cells[need].tobytes(), dist[need].tobytes()
                    for g in range(class_first[c], class_first[c] + class_many[c]):
                        for col, x in zip(rows, (g, count % class_slices[c], *packed), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[2:])], names=["g", "slice", "ids", "rows", "vecs", "cells", "dists"])

    def asking(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            qcell, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            g = first[qcell] + row % many[qcell]
            yield pa.RecordBatch.from_arrays([pa.array(g), *batch.columns, pa.array(class_slices[kind[qcell]])], names=["g", "vec_id", "vec", "qcell", "row", "slices"])

    data = assigned.select("vec_id", "vec", "cell", "dist", "row").mapInArrow(blocks, "g long, slice int, ids binary, rows binary, vecs binary, cells binary, dists binary")
    asked = assigned.where("qcell >= 0").select("vec_id", "vec", "qcell", "row").mapInArrow(asking, "g long, vec_id long, vec binary, qcell int, row long, slices long")
    asked = asked.select("g", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"), "vec_id", "vec", "qcell", "row")
    found = asked.groupBy("g", "slice").cogroup(data.groupBy("g", "slice")).applyInPandas(solver(shared_between, reach, dim, k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
