"""Nearest neighbours by cosine: a block matrix join with int8 tiles.

The stated queries are taken in blocks of at most ``query_block`` vectors and ``BLOCK_BYTES`` (a bounded
broadcast; the driver holds one at a time); each block is a job of its own, one scan of all rows whose heaps are written before the next begins.
A task lays its rows out in tiles. For a tile and some queries of the block (``STEP`` at a time, so the products take a few MB) the product of the int8 codes (exact, in float32, over at most 1,024
dimensions at a time) gives every pair's cosine up to a bound: with x = s q + e for a unit vector,

    |x . y - s_x s_y (q_x . q_y)|  <=  |s_x q_x| |e_y| + |e_x|

Each query keeps a heap of its best rows; only pairs whose upper bound reaches the
heap's worst are computed again from the original vectors, in double precision, one
dimension after the other, so that equal vectors get equal scores wherever they are.
A task sends at most ``k`` rows of a query, and one more heap for each query merges the tasks', many queries in a batch. The search is
exact: the bounds drop a pair only if it can't be among the k.

Defined results: vectors that are null, zero, or hold nulls or non-finite components take no part, neither as
queries nor as candidates; nor do null ids. Only vectors of equal length are compared. Rows that
repeat a query's id are the query's own; a query repeated with several vectors is searched by the
smallest of them; ties go to the smaller vec_id. Vectors of any length are taken, in parts of 1,024 dimensions. Extra columns are not read and not returned; an empty
table, or no queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

TILE, STEP, BLOCK_BYTES = 2048, 512, 16 << 20


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sum(parts: Iterator[np.ndarray], n: int) -> np.ndarray:
    total = np.zeros(n)
    for x in parts:
        total = total + x
    return total


@dataclass
class Coded:
    """Vectors of one length: the originals, their norms, and int8 codes with their errors."""

    ids: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    code: np.ndarray  #: int8
    scale: np.ndarray
    length: np.ndarray  #: of scale * code
    error: np.ndarray  #: of the unit vector minus scale * code

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Coded:
        x = x.astype(np.float64)
        largest = np.abs(x).max(1)
        y = x / largest[:, None]  # no overflow in the squares below
        norm = np.sqrt(_sum((x[:, d] * x[:, d] for d in range(x.shape[1])), len(x)))
        unit = y / np.sqrt((y * y).sum(1))[:, None]
        scale = np.abs(unit).max(1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        back = code * scale[:, None]
        # 1e-9: more than what rounding in double precision can add
        return Coded(ids, x, norm, code, scale, np.sqrt((back * back).sum(1)) + 1e-9, np.sqrt(((unit - back) ** 2).sum(1)) + 1e-9)

    def product(self, other: Coded) -> np.ndarray:
        out = np.zeros((len(self.ids), len(other.ids)))
        for d in range(0, self.code.shape[1], 1024):  # 1024 * 127 ** 2 < 2 ** 24: exact
            out += self.code[:, d : d + 1024].astype(np.float32) @ other.code[:, d : d + 1024].astype(np.float32).T
        return out

    def part(self, s: int, e: int) -> Coded:
        return Coded(*(x[s:e] for x in (self.ids, self.x, self.norm, self.code, self.scale, self.length, self.error)))

    def exact(self, i: np.ndarray, other: Coded, j: np.ndarray) -> np.ndarray:
        dot = _sum((self.x[i, d] * other.x[j, d] for d in range(self.x.shape[1])), len(i))
        return dot / (self.norm[i] * other.norm[j])


def _by_length(ids: np.ndarray, vectors: pa.Array) -> Iterator[Coded]:
    """A tile for each vector length."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        yield Coded.of(ids[of], flat[starts[of][:, None] + np.arange(n)])


class Heaps:
    """The k best (score, -id) of each query."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps, self.worst = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def push(self, q: int, score: float, vec_id: int) -> None:
        heap, entry = self.heaps[q], (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.worst[q] = heap[0][0]

    def best(self, q: int) -> list[tuple[float, int]]:
        return [(s, -i) for s, i in sorted(self.heaps[q], reverse=True)]


def _search(queries: Coded, tile: Coded, heaps: Heaps) -> None:
    for first in range(0, len(queries.ids), STEP):
        _search_step(queries.part(first, first + STEP), first, tile, heaps)


def _search_step(queries: Coded, first: int, tile: Coded, heaps: Heaps) -> None:
    middle = queries.product(tile) * queries.scale[:, None] * tile.scale[None]
    bound = queries.length[:, None] * tile.error[None] + queries.error[:, None]
    own = queries.ids[:, None] == tile.ids[None]
    # with k rows of the tile whose lower bounds are at least b, nothing with an upper bound below b is needed
    low = np.where(own, -np.inf, middle - bound)
    least = heaps.worst[first : first + len(queries.ids)].copy()
    if tile.ids.shape[0] > heaps.k:
        least = np.maximum(least, np.partition(low, -heaps.k, 1)[:, -heaps.k])
    q, t = np.nonzero(~own & (middle + bound >= least[:, None]))
    for s in range(0, len(q), 200_000):
        i, j = q[s : s + 200_000], t[s : s + 200_000]
        score = queries.exact(i, tile, j)
        near = score >= heaps.worst[first + i]
        order = np.lexsort((tile.ids[j][near], -score[near]))
        for a, v, d in zip((first + i[near][order]).tolist(), tile.ids[j][near][order].tolist(), score[near][order].tolist(), strict=True):
            if d >= heaps.worst[a]:
                heaps.push(a, d, v)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for batch in batches:
        for s in range(0, batch.num_rows, TILE):
            part = batch.slice(s, TILE)
            yield from _by_length(part.column("vec_id").to_numpy(), part.column("embedding"))


def search(base: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``base`` to each of ``queries`` (vec_id, embedding)."""
    spark = base.sparkSession
    good = [df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) for df in (base, queries)]
    asked = materialise(good[1].groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = []
    for block in _query_blocks(asked, query_block):
        shared = spark.sparkContext.broadcast(block)
        parts.append(materialise(_search_block(good[0], shared, k), "heaps"))
        shared.destroy()
    discard(asked)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema(parts[0].schema).parquet(*(x._siltstone_path for x in parts))
    return found.repartition(F.col("query_id")).sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def _merge(k: int):
    """The best rows of each query from rows sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, out = None, Heaps(1, k), []

        def take() -> None:
            out.extend((now, r, i, s) for r, (s, i) in enumerate(heap.best(0), 1))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != now:
                    if now is not None:
                        take()
                    now, heap = q, Heaps(1, k)
                heap.push(0, s, i)
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        if now is not None:
            take()
        if out:
            yield batch_of()

    return run


def _query_blocks(asked: DataFrame, size: int) -> Iterator[list[Coded]]:
    """Streamed to the driver, a block at a time."""
    ids, vectors, held = [], [], 0

    def block() -> list[Coded]:
        return list(_by_length(np.array(ids, np.int64), pa.array(vectors, pa.list_(pa.float64()))))

    for row in asked.toLocalIterator():
        ids.append(row.vec_id)
        vectors.append(row.embedding)
        held += 8 * len(row.embedding)
        if len(ids) == size or held >= BLOCK_BYTES:
            yield block()
            ids, vectors, held = [], [], 0
    if ids:
        yield block()


def _search_block(base: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        heaps = [Heaps(len(b.ids), k) for b in blocks]
        for tile in _tiles(batches):
            for block, h in zip(blocks, heaps, strict=True):
                if block.x.shape[1] == tile.x.shape[1]:
                    _search(block, tile, h)
        rows = [(int(b.ids[q]), i, s) for b, h in zip(blocks, heaps, strict=True) for q in range(len(b.ids)) for s, i in h.best(q)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return base.mapInArrow(run, "query_id long, vec_id long, score double")
