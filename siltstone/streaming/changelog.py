"""The change-log as a stream: micro-batches of changes into a table, and a table's deltas as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import VectorTable


def changes(spark: SparkSession, path: str, table: VectorTable, max_files: int = 1000) -> DataFrame:
    """A stream of change rows from a folder of Parquet files in the change-log's format."""
    return spark.readStream.schema(table.schema.changelog()).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest(stream: DataFrame, table: VectorTable, checkpoint: str) -> StreamingQuery:
    """Applies change rows (op PUT, UPDATE or DELETE; PUT and UPDATE rows hold the whole new version) to ``table``, all that are there, and ends.

    The source's seq stays the row's seq, so a row that comes late, in whatever batch, never replaces a newer one. A batch that is run again after
    a failure adds versions that are there already, and changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        table.replay(batch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
