"""Opt-in approximate search: an inverted file of cells.

``fit`` finds centroids on a bounded sample, ``assign`` gives every row the cell of its nearest centroid, and a search
reads the cells nearest to the query: an equality on the partition column, so other cells' files are not opened. How many
cells are probed grows with the number of comparisons in the filter, since a filter thins the cells out. A table keeps an index with its base
(``VectorTable.create_index``): rows are assigned once, when they are compacted, and what was written since is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..plans import query as plans
from ..plans.predicate import comparisons, parse
from ..sources.schema import Schema
from .batch import best_rows


@dataclass(frozen=True)
class CellIndex:
    centroids: np.ndarray

    @staticmethod
    def fit(records: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> CellIndex:
        rows = _sample(records.where("vector is not null").select("vector"), sample)
        if not rows:
            raise InvalidArgument("no vectors to fit on")
        x = np.array([r.vector for r in rows], np.float64)
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[:cells]].copy()
        for _ in range(rounds):
            near = _nearest(x, c)
            for i in range(len(c)):
                if (near == i).any():
                    c[i] = x[near == i].mean(0)
        return CellIndex(c)

    def assign(self, records: DataFrame) -> DataFrame:
        """``records`` with their cell; null without a vector. Write it partitioned by cell."""
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column("vector")
                have, cells = vectors.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(vectors), np.int32)
                if have.any():
                    if not pc.all(pc.equal(pc.list_value_length(vectors), c.shape[1])).as_py():
                        raise InvalidArgument(f"vectors of other lengths than the index's {c.shape[1]}")
                    cells[have] = _nearest(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1]), c)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, mask=~have)], names=[*batch.schema.names, "cell"])

        return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("cell", T.IntegerType())]))

    def probes(self, vector: Sequence[float], n: int) -> list[int]:
        d = ((self.centroids - np.asarray(vector, np.float64)) ** 2).sum(1)
        return np.argsort(d, kind="stable")[:n].tolist()

    def to_json(self) -> list:
        return self.centroids.tolist()

    @staticmethod
    def from_json(data: list) -> CellIndex:
        return CellIndex(np.array(data, np.float64))

    def widened(self, probes: int, compared: int) -> int:
        """Cells to probe for a filter of so many comparisons."""
        return min(len(self.centroids), probes * (10 + compared) // 10)

    def knn_join(self, queries: DataFrame, assigned: DataFrame, k: int, metric: str = "l2", probes: int = 8) -> DataFrame:
        """query_key, rank, key, distance: each query's ``k`` nearest rows of its ``probes`` cells. ``queries``: key, vector; ``assigned``: key, vector, cell.
        Rows stay where they are: a task meets them with the queries of their cells and sends each query's ``k`` best, as ``batch.knn_join`` does."""
        c = self.centroids

        def reads(vectors: np.ndarray) -> np.ndarray:
            out, step = np.zeros((len(vectors), len(c)), bool), max(1, 2**20 // c.size)
            for s in range(0, len(vectors), step):
                d = ((c[None] - vectors[s : s + step, None]) ** 2).sum(2)
                np.put_along_axis(out[s : s + step], np.argsort(d, axis=1, kind="stable")[:, :probes], True, 1)
            return out

        d = best_rows(queries, assigned, k, metric, reads)
        rank = Window.partitionBy("query_key").orderBy("distance", "key")
        return d.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_key", "rank", "key", "distance")

    def search(self, assigned: DataFrame, schema: Schema, filter: str | None, vector: Sequence[float], options: plans.Options, probes: int = 8) -> DataFrame:  # noqa: A002
        some = assigned.where(F.col("cell").isin(self.probes(vector, self.widened(probes, comparisons(parse(filter, schema))))))
        return plans.plan(some, schema, filter, vector, options)


def _sample(vectors: DataFrame, size: int) -> list:
    """The ``size`` rows of the smallest hashes. Of more rows, only those with a hash in the lowest part are ordered: as large a part as gives enough of them."""
    order, part = F.xxhash64("vector"), 1.1 * size / max(vectors.count(), 1)
    while True:
        some = vectors if part >= 1 else vectors.where(order < F.lit(int(part * 2**64) - 2**63))
        rows = some.orderBy(order).limit(size).collect()
        if part >= 1 or len(rows) == size:
            return rows
        part *= 4


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1)[None] - 2 * x[s : s + 4096] @ c.T).argmin(1) for s in range(0, len(x), 4096)])
