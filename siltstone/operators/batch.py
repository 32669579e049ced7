"""Nearest rows of a base table to many query vectors at once, exactly.

Queries go out in blocks of a bounded size; a task keeps each query's k best of its rows, and a window over
at most k rows a task and query picks the final ones. A matrix product gives all distances up to a bound on its rounding; those that may be among the
best are folded dimension by dimension in double precision, as the
Column functions do, so both ways give the same scores. The search of an index's cells (``ann``) takes the same way over the rows of its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import distance

BLOCK_BYTES = 16 << 20


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Of pairs, given as two lists of vectors, folded."""
    out = np.zeros(len(queries))
    for d in range(rows.shape[1]):
        a, b = rows[:, d], queries[:, d]
        out = out + ((a - b) * (a - b) if metric == "l2" else a * b)
    return out if metric == "l2" else -out


def _fewer_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Of equal rows the first ``k``: with rows in the order of their keys, a later one is among no query's ``k`` best."""
    same = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, group, count = np.unique(same, return_inverse=True, return_counts=True)
    if count.max() <= k:
        return np.arange(len(rows))
    order = np.argsort(group, kind="stable")
    return np.sort(order[np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) < k])


def _best(ids: list, vectors: np.ndarray, metric: str, k: int, arrow: pa.Schema, reads: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's ``k`` best rows of a task. With ``reads`` (of each query and cell: whether it is searched), rows have a cell, and a query meets those of its cells only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        worst = np.full(len(ids), np.inf)
        read = reads(vectors) if reads else None
        # a lower bound is the product with -2 q (or -q), and a share of both squares; the error of the product is far below 4e-12 of them
        factor, share = (-2.0, 1 - 4e-12) if metric == "l2" else (-1.0, -4e-12)
        asked, squares = factor * vectors, (vectors * vectors).sum(1)

        def meet(some: np.ndarray, rows: np.ndarray, keys: list) -> None:
            square = (rows * rows).sum(1)
            for q0 in range(0, len(some), 256):
                of = some[q0 : q0 + 256]
                low = asked[of] @ rows.T
                low += (share * squares[of] - 1e-300)[:, None]
                low += (share * square)[None]
                near = low <= worst[of][:, None]
                if len(rows) > k and np.count_nonzero(near) > 4 * k * len(of):
                    high = low + (8e-12 * (squares[of][:, None] + square[None]) + 2e-300)
                    near &= low <= np.fmin(np.partition(high, k - 1, 1)[:, k - 1, None], np.inf)  # not a number: fewer than k that count
                q, i = np.divmod(np.flatnonzero(near), len(rows))
                q, step = of[q], max(1, 2**19 // rows.shape[1])
                for s in range(0, len(q), step):
                    take(q[s : s + step], i[s : s + step], rows, keys)

        def take(q: np.ndarray, i: np.ndarray, rows: np.ndarray, keys: list) -> None:
            exact = _distances(vectors[q], rows[i], metric)
            good = exact <= worst[q]
            q, i, exact = q[good], i[good], exact[good]
            order = np.lexsort((i, exact, q))  # i is the order of the keys
            q, i, exact = q[order], i[order], exact[order]
            starts = np.flatnonzero(np.diff(q, prepend=-1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(q)], strict=True):
                e, x = min(e, s + k), int(q[s])
                best[x] = sorted([*best[x], *zip(exact[s:e].tolist(), [keys[y] for y in i[s:e].tolist()], strict=True)])[:k]
                if len(best[x]) == k:
                    worst[x] = best[x][-1][0]

        for batch in batches:
            some = batch.filter(pc.equal(pc.list_value_length(batch.column("vector")), vectors.shape[1]))
            if not some.num_rows:
                continue
            cells = np.zeros(some.num_rows, np.int64) if read is None else some.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                queries = np.arange(len(ids)) if read is None else np.flatnonzero(read[:, cell])
                at = np.flatnonzero(cells == cell)
                for s in range(0, len(at) if len(queries) else 0, 2048):
                    part = some.take(pa.array(at[s : s + 2048]))
                    part = part.take(pc.array_sort_indices(part.column("key"), null_placement="at_start"))
                    rows = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    kept = _fewer_copies(rows, k)
                    meet(queries, rows[kept].astype(np.float64), part.column("key").take(pa.array(kept)).to_pylist())
        rows_ = [(ids[q], key, d) for q, found in enumerate(best) for d, key in found]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), arrow, strict=True)], schema=arrow)

    return run


def best_rows(queries: DataFrame, base: DataFrame, k: int, metric: str, reads: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_key, key, distance: each query's ``k`` best rows of each task, a scan of the base for each block of queries. With ``reads``, see ``_best``."""
    schema = StructType([StructField("query_key", queries.schema["key"].dataType), StructField("key", base.schema["key"].dataType), StructField("distance", DoubleType())])
    rows, found = base.select("key", "vector", *(["cell"] if reads else [])), None
    for ids, vectors in _blocks(queries.where("vector is not null").select("key", "vector")):
        part = rows.mapInArrow(_best(ids, vectors, metric, k, to_arrow_schema(schema), reads), schema)
        found = part if found is None else found.union(part)
    return base.sparkSession.createDataFrame([], schema) if found is None else found


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", vector_type: str = "f32", exclude_self: bool = False) -> DataFrame:
    """query_key, rank, key, distance, vector_score. Both sides: key (a number or a string) and vector; rows without a vector take no part."""
    found = best_rows(queries, base, k + 1 if exclude_self else k, metric)
    if exclude_self:
        found = found.where("query_key <> key")
    rank = Window.partitionBy("query_key").orderBy("distance", "key")
    out = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_key", "rank", "key", "distance", distance.score_of(F.col("distance"), metric).alias("vector_score"))


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Streamed from the cluster; a block is sent to tasks with their function, so it is kept small."""
    ids, vectors, held = [], [], 0
    for row in queries.toLocalIterator():
        if vectors and (held >= BLOCK_BYTES or len(row.vector) != len(vectors[0])):
            yield ids, np.array(vectors, np.float64)
            ids, vectors, held = [], [], 0
        ids.append(row.key)
        vectors.append(row.vector)
        held += 8 * len(row.vector)
    if ids:
        yield ids, np.array(vectors, np.float64)


def knn_join_sql(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", vector_type: str = "f32") -> DataFrame:
    """The same with Column functions only, for few queries: a block of them is one array of at most about ``BLOCK_BYTES``, and each block reads the base."""
    spark = base.sparkSession
    asked = queries.where("vector is not null").select(F.col("key").alias("query_key"), F.col("vector").alias("query_vector"))
    kind = StructType([StructField("asked", ArrayType(asked.schema))])
    scored = None
    for block in _rows(asked):
        pairs = base.where("vector is not null").join(F.broadcast(spark.createDataFrame([(block,)], kind))).select("key", "vector", F.explode("asked").alias("q"))
        part = pairs.select("q.query_key", "key", distance.distance(F.col("vector"), F.col("q.query_vector"), metric, vector_type).cast("double").alias("distance"))
        scored = part if scored is None else scored.union(part)
    if scored is None:
        scored = spark.createDataFrame([], StructType([asked.schema["query_key"], base.schema["key"], StructField("distance", DoubleType())]))
    rank = Window.partitionBy("query_key").orderBy("distance", "key")
    out = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_key", "rank", "key", "distance", distance.score_of(F.col("distance"), metric).alias("vector_score"))


def _rows(asked: DataFrame) -> Iterator[list]:
    """Blocks of queries, streamed from the cluster."""
    block, held = [], 0
    for row in asked.toLocalIterator():
        block.append(row)
        held += 8 * len(row.query_vector)
        if held >= BLOCK_BYTES or len(block) == 1024:
            yield block
            block, held = [], 0
    if block:
        yield block
