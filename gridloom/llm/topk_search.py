"""Exact top-k search by inner product as a Voronoi kNN join.

One more coordinate turns the largest inner product into the least distance. Pivots part the vectors into
cells. From summaries of the cells follows, for each group of queries, a distance within which its nearest
vectors lie; a vector goes to a group only if it may be as near. Groups are solved block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import cut

#: Pivots, and so cells and groups of queries; does not grow with the data.
PIVOTS = 12
#: Queries and vectors that one task holds at a time, about.
BLOCK_QUERIES, BLOCK_VECTORS = 512, 8192
#: Slack on distances computed in floating point.
SLACK = 1e-6


def integer_vectors(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * component); without rows that are null or hold null or non-finite ones."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return table.where("vec_id is not null and embedding is not null").where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<long> column, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class _Space:
    """Pivots in the space with one more coordinate, in which the nearest is the one of largest inner product."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.dim, self.top = pivots.shape[1], top
        self.pivots = self.lift(pivots)
        self.between = np.sqrt(np.maximum(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2), 0))

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        v = v.astype(np.float64)
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.top - (v**2).sum(1), 0))
        return np.column_stack([v, rest])

    def distances(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        a, b = self.lift(v, query), self.pivots
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def _assign(shared, query: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if batch.num_rows:
                d = space.distances(_matrix(batch.column("v"), space.dim), query)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "away"])

    return task


def _spread(shared):
    """Each vector once for each block of each group of queries that it may be among the nearest of."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, reach, blocks, chunks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            need = space.distances(_matrix(batch.column("v"), space.dim)) <= reach[None]
            row, group = np.nonzero(need)
            times = blocks[group]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, group = np.repeat(row, times), np.repeat(group, times)
            ids = batch.column("vec_id").to_numpy()
            chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(chunks)
            for lo in range(0, len(row), 20_000):
                part = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[part].astype(np.int32)), pa.array(block[part].astype(np.int32)), pa.array(chunk[row[part]].astype(np.int32)), *(c.take(pa.array(row[part])) for c in (batch.column("vec_id"), batch.column("v")))],
                    ["grp", "block", "chunk", "vec_id", "v"],
                )

    return task


def _solve(dim: int, k: int, exact: bool):
    kind = np.float64 if exact else np.int64  # sums below 2^53 are whole in floating point

    def task(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        vectors = vectors.combine_chunks().sort_by("vec_id")
        v, ids = _matrix(vectors.column("v").combine_chunks(), dim).astype(kind).T, vectors.column("vec_id").to_numpy()
        qs, q_ids = _matrix(queries.column("v").combine_chunks(), dim).astype(kind), queries.column("query_id").to_numpy()
        out = []
        for q, q_id in zip(qs, q_ids):
            s = q @ v
            own = ids == q_id
            n = min(k + int(own.sum()), len(s))
            # all that reach the n-th score, then ties by vec_id: ids ascend and the sort is stable
            near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
            near = near[np.argsort(-s[near], kind="stable")]
            near = near[~own[near]][:k]
            out.append((np.full(len(near), q_id), ids[near], s[near].astype(np.int64)))
        return pa.table([np.concatenate(c) for c in zip(*out)], names)

    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query (vec_id, v) the k vectors (vec_id, v) of largest inner product.

    Ties go to the smaller vec_id; a vector with the query's own id is no candidate; with fewer candidates
    all of them are returned. Vectors of fewer components count as padded with zeros. Rows that share an
    id are candidates of their own, and queries with one id share their result's ranks. No row is lost to
    the bounds: they hold for every vector, with slack for rounding. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim")).first()
    wide = queries.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    if not facts.n or not wide.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, facts.dim, wide.dim)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toArrow()
    space = _Space(_matrix(drawn.column("v").combine_chunks(), dim), facts.top)
    context = spark.sparkContext
    shared = context.broadcast(space)
    places = "vec_id long, v array<long>, cell int, away double"
    homes = vectors.mapInArrow(_assign(shared, False), places).select("vec_id", "cell", "away")
    asked = cut(queries.mapInArrow(_assign(shared, True), places), "queries")
    # summaries: the k + 1 vectors nearest to each pivot, and the farthest query and number of queries of each group
    nearest = homes.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("away", "vec_id"))).where(F.col("n") <= k + 1)
    near = nearest.select("cell", "away").toPandas()
    groups = asked.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).toPandas()
    reach, blocks = np.full(len(space.pivots), -1.0), np.zeros(len(space.pivots), np.int64)
    for cell, far, n in groups.itertuples(index=False):
        bound = np.sort(far + space.between[cell][near["cell"].to_numpy(int)] + near["away"].to_numpy())
        within = bound[k] if len(bound) > k else np.inf
        reach[cell] = (within + far) * (1 + SLACK) + SLACK
        blocks[cell] = -(-n // BLOCK_QUERIES)
    chunks = max(1, round(facts.n / BLOCK_VECTORS))
    many = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(blocks, 1)]), F.col("cell") + 1)
    dealt = asked.select(F.col("cell").alias("grp"), F.pmod(F.xxhash64("vec_id"), many).cast("int").alias("block"), F.explode(F.expr(f"sequence(0, {chunks - 1})")).alias("chunk"), F.col("vec_id").alias("query_id"), "v")
    sent = vectors.mapInArrow(_spread(context.broadcast((space, reach, blocks, chunks))), "grp int, block int, chunk int, vec_id long, v array<long>")
    keys = ["grp", "block", "chunk"]
    exact = max(facts.top, wide.top) * 1.01 < 2.0**53
    local = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solve(dim, k, exact), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
