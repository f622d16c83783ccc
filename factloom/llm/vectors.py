"""Exact top-k search by columnar branch-and-bound.

Branch: each vector belongs to the cell of the nearest of some pivots (a bounded sample of the vectors), and a cell is cut
into candidate blocks of bounded size. Queries form blocks of neighbouring cells. A first pass searches one block of each
query's own surroundings, which proves a floor: its k-th best score is this at least. What a cell can offer a query is at
most its product with the pivot plus its length times the cell's radius, so only blocks of cells that may reach the floor
of some query of a block are sent to it.

Bound: inside a pair of blocks, vectors stand in vertical layout (a row for each dimension, most widely spread first).
Scores accumulate a block of dimensions at a time; what the rest can add is at most the product of the remaining masses
(Cauchy-Schwarz), so candidates whose bound lies under the floor or under the k-th best proven score are dropped and the
survivors compacted before the next block. Each pair returns k rows for each query; a last step keeps the best k.

Edge cases: a vector that is null or holds a null or non-finite component takes no part, nor does one whose id is null.
Vectors of different lengths have no product: each meets those of its own length. Ids may repeat: each row is a query and a
candidate of its own, and only the row itself is kept from its query, so equal ids give equal query_ids with ranks of
their own (all from 1). Ties go to the smaller id. Other columns are ignored, whatever their names; an empty table gives
no rows. Scores are exact: vectors with sums beyond 2**53 are worked on as Python integers, and a score beyond a long
raises.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import Scratch

BLOCK, QUERIES, DIMS = 4096, 1024, 16
#: Pivots for each length of vectors at most; fewer where the cells would be smaller than a block.
PIVOTS = 256


def best(q: np.ndarray, c: np.ndarray, q_rows: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int, floors: np.ndarray | None = None, dims: int = DIMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q, the positions in c of its k best by (score descending, id ascending), without its own row, and their scores.

    With ``floors``, those under a query's floor may be left out.
    """
    floors = np.full(len(q), -np.inf) if floors is None else floors
    exact = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**52
    if not exact:
        out = []
        whole = [[int(x) for x in row] for row in c]
        for i, row in enumerate(q):
            mine = [int(x) for x in row]
            scored = sorted((-sum(a * b for a, b in zip(mine, other, strict=True)), int(c_ids[j]), j) for j, other in enumerate(whole) if c_rows[j] != q_rows[i])[:k]
            out.append((np.array([j for _, _, j in scored], int), np.array([-s for s, _, _ in scored], np.int64)))
        return out
    order = np.argsort(-c.std(0), kind="stable")
    qt, ct = np.ascontiguousarray(q[:, order].T), np.ascontiguousarray(c[:, order].T)  # dimensions x vectors
    d = len(order)
    cuts = list(range(0, d, dims)) + [d]
    left_q = [np.sqrt((qt[b:] ** 2).sum(0)) for b in cuts]
    left_c = [np.sqrt((ct[b:] ** 2).sum(0)) for b in cuts]
    # The first block of dimensions has no bound yet: all at once.
    part = qt[: cuts[1]].T @ ct[: cuts[1]] if d else np.zeros((len(q), len(c)))
    out = []
    for i in range(len(q)):
        live, score = np.arange(len(c)), part[i]
        own = c_rows == q_rows[i]
        if own.any():
            live, score = live[~own], score[~own]
        for b in range(1, len(cuts)):
            rest = left_q[b][i] * left_c[b][live]
            if b < len(cuts) - 1:
                floor = floors[i]
                if len(live) > k:
                    floor = max(floor, np.partition(score - rest, len(live) - k)[len(live) - k])  # the k-th best score is this at least
                if floor > -np.inf:
                    keep = score + rest >= floor - 1e-6 * (1 + abs(floor))
                    live, score = live[keep], score[keep]
                score = score + qt[cuts[b] : cuts[b + 1], i] @ ct[cuts[b] : cuts[b + 1], live]
        top = np.lexsort((c_ids[live], -score))[:k]
        out.append((live[top], np.rint(score[top]).astype(np.int64)))
    return out


def _matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    flat = t.column(name).combine_chunks().flatten().to_numpy()
    return flat.reshape(t.num_rows, len(flat) // max(t.num_rows, 1))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each the furthest from those before it: no cluster of the sample is left without one."""
    picked, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(n, len(x)):
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def chained(x: np.ndarray) -> np.ndarray:
    """Vectors in an order in which each is followed by the nearest of those left, so neighbours have close numbers."""
    left, order = list(range(1, len(x))), [0]
    while left:
        far = ((x[left] - x[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(np.argmin(far))))
    return x[order]


def _cells(pivots: dict[int, np.ndarray]):
    """Adds the cell (number of the nearest pivot of its length) and the distance to that pivot to each vector."""

    def cells(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            cell, far = np.zeros(len(d), np.int32), np.zeros(len(d))
            for size in np.unique(d).tolist():
                mine, p = np.flatnonzero(d == size), pivots[size]
                x = _matrix(pa.table({"v": batch.column("v").take(pa.array(mine))}))
                with np.errstate(over="ignore", invalid="ignore"):
                    cell[mine] = np.argmax(x @ p.T - (p**2).sum(1) / 2, 1)
                    far[mine] = np.sqrt(((x - p[cell[mine]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return cells


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by ``every``, against all other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    floor = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, a double is whole
    whole = F.transform(x, lambda v: floor(v * scale))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).withColumn("d", F.size("v"))
    # Pivots come from the vectors of the smallest hashes, PIVOTS of each length at most; one for a block of vectors.
    nth = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("vec_id", "v"), "vec_id"))
    sample = rows.withColumn("n", nth).where(F.col("n") <= PIVOTS).select("d", "v").collect()  # PIVOTS rows of each length at most
    sizes = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # a row for each length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of = lambda d: [r["v"] for r in sample if r["d"] == d]
    pivots = {d: chained(spread(np.array(of(d), float).reshape(len(of(d)), d), -(-n // block))) for d, n in sizes.items()}
    held = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_cells(pivots), "vec_id long, v array<double>, d int, _row long, cell int, far double")
    held = scratch.table(held, "cells")  # written once, so a row keeps its number

    # A line for each cell: how many candidate blocks it has, and which query blocks its queries are dealt to.
    is_query = F.col("vec_id") % every == 0
    stats = held.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(is_query).alias("n_q")).orderBy("d", "cell").collect()  # PIVOTS of each length at most
    plan, at, room = [], -1, 0
    for i, r in enumerate(stats):
        if i and r["d"] != stats[i - 1]["d"] or r["n_q"] > room:
            at, room = at + 1, query_block
        several = max(1, -(-r["n_q"] // query_block))
        plan.append((r["d"], r["cell"], -(-r["n"] // block), at, several))
        at, room = (at, room - r["n_q"]) if several == 1 else (at + several - 1, 0)
    cells = spark.createDataFrame(plan, "d int, cell int, n_blocks int, first_q int, n_q int")
    radius = {d: np.array([next((r["radius"] for r in stats if (r["d"], r["cell"]) == (d, i)), -np.inf) for i in range(len(p))]) for d, p in pivots.items()}
    sent = spark.sparkContext.broadcast((pivots, radius))  # PIVOTS vectors of each length at most
    deal = lambda n, seed: F.pmod(F.xxhash64("_row", F.lit(seed)), F.col(n)).cast("int")
    held = held.join(F.broadcast(cells), ["d", "cell"]).withColumn("cb", deal("n_blocks", 1))
    queries = held.where(is_query).withColumn("qb", F.col("first_q") + deal("n_q", 2)).select("_row", "vec_id", "v", "d", "qb")
    sides = [F.col("_row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("v").alias("c")]

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        """A floor for each query from the blocks around it, and the cells that may reach the floor of any query of the block."""
        pivots, radius = sent.value
        d = left.column("d")[0].as_py() if left.num_rows else 0
        floors = np.full(left.num_rows, -np.inf)
        q, c = _matrix(left), _matrix(right, "c")
        if left.num_rows and right.num_rows >= k:
            q_rows, c_rows = left.column("_row").to_numpy(), right.column("c_row").to_numpy()
            for i, (_, s) in enumerate(best(q, c, q_rows, c_rows, right.column("c_id").to_numpy(), k)):
                floors[i] = s[-1] if len(s) == k else -np.inf
        reached = []
        if left.num_rows:
            with np.errstate(over="ignore", invalid="ignore"):
                most = q @ pivots[d].T + np.sqrt((q**2).sum(1))[:, None] * radius[d]
                reached = np.flatnonzero(~(most + 1e-6 * (1 + np.abs(most)) < floors[:, None]).all(0)).tolist()
        return pa.table({"_row": left.column("_row"), "floor": floors, "reached": pa.array([reached] * left.num_rows, pa.list_(pa.int32()))})

    near = held.where("cb = 0").select(*sides, F.explode(F.sequence(F.col("first_q"), F.col("first_q") + F.col("n_q") - 1)).alias("near_qb"))
    floors = queries.groupBy("qb").cogroup(near.groupBy("near_qb")).applyInArrow(probe, "_row long, floor double, reached array<int>")
    floors = scratch.table(floors.withColumnRenamed("_row", "_q"), "floors")
    queries = scratch.table(queries.join(floors, F.col("_row") == F.col("_q")).drop("_q"), "queries")
    # Pairs of a query block and a candidate block that may matter.
    pairs = queries.select("qb", "d", "reached").distinct().select("qb", "d", F.explode("reached").alias("cell")).join(F.broadcast(cells.select("d", "cell", "n_blocks")), ["d", "cell"])
    pairs = pairs.select("qb", "d", "cell", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("cb"))
    pairs = scratch.table(pairs, "pairs")
    asked = queries.drop("reached").join(pairs, ["qb", "d"])
    to = pairs.toDF("to_qb", "to_d", "to_cell", "to_cb")
    offered = held.join(to, (F.col("d") == F.col("to_d")) & (F.col("cell") == F.col("to_cell")) & (F.col("cb") == F.col("to_cb"))).select(*sides, *to.columns)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q_rows, c_ids = left.column("_row").to_numpy(), right.column("c_id").to_numpy()
        got = best(_matrix(left), _matrix(right, "c"), q_rows, right.column("c_row").to_numpy(), c_ids, k, left.column("floor").to_numpy()) if len(q_rows) and len(c_ids) else []
        size = [len(a) for a, _ in got]
        none = [np.empty(0, np.int64)]
        of = np.repeat(np.arange(len(got)), size).astype(np.int64)
        return pa.table({"_row": q_rows[of], "query_id": left.column("vec_id").to_numpy()[of], "vec_id": np.concatenate([c_ids[a] for a, _ in got] or none), "score": np.concatenate([s for _, s in got] or none)})

    found = asked.groupBy("qb", "d", "cell", "cb").cogroup(offered.groupBy(*to.columns)).applyInArrow(search, "_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
