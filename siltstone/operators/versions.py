"""Newest version per key, merge of a base with later changes, compaction.

The newest version is picked before any filter on its content, so an old version that would match never comes up for a newer
one that doesn't. The plan is a row number limited to one, which Spark cuts down within each task before the shuffle: a
key with very many versions moves one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The newest version of every key, tombstones among them."""
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return log.withColumn("_version", F.row_number().over(newest)).where("_version = 1").drop("_version")


def current(log: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", tombstone: str = "DELETE") -> DataFrame:
    """The newest version of every key that isn't deleted."""
    return latest(log, key, seq).where(F.col(op) != tombstone)


def merge(base: DataFrame, delta: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", tombstone: str = "DELETE") -> DataFrame:
    """The live records of a base and the changes after it, by one union and one pass."""
    return current(base.unionByName(delta, allowMissingColumns=True), key, seq, op, tombstone)


def compact(log: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", tombstone: str = "DELETE") -> DataFrame:
    """The live records in key order over range partitions, so that files have narrow key ranges."""
    return current(log, key, seq, op, tombstone).repartitionByRange(F.col(key)).sortWithinPartitions(key)


def put(log: DataFrame, rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Full replacement: what the new rows don't say is absent."""
    return log.unionByName(rows.withColumn("op", F.lit("PUT")), allowMissingColumns=True)


def update(log: DataFrame, rows: DataFrame, columns: list[str], key: str = "key", seq: str = "seq") -> DataFrame:
    """New versions of existing records with ``columns`` of ``rows`` (key, seq, columns; a null leaves what was there). Unknown keys are left out."""
    live = current(log, key, seq)
    new = rows.select(key, F.col(seq).alias("_seq"), *[F.col(c).alias(f"_{c}") for c in columns])
    updated = live.join(new, key).withColumns({seq: F.col("_seq"), "op": F.lit("UPDATE")} | {c: F.coalesce(f"_{c}", c) for c in columns})
    return log.unionByName(updated.select(log.columns))


def delete(log: DataFrame, keys: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Tombstones for the keys (key, seq) that are live."""
    live = current(log, key, seq).select(key)
    gone = keys.join(live, key, "left_semi").withColumn("op", F.lit("DELETE"))
    return log.unionByName(gone.select(key, seq, "op"), allowMissingColumns=True)
