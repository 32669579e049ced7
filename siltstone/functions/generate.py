"""Seeded vectors: each component is a hash of the seed, the row and its place, so rows don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def vectors(spark: SparkSession, n: int, dim: int, seed: int = 1234, vector_type: str = "f32") -> DataFrame:
    """key (0 to ``n`` - 1) and vector: float32 uniform in [-1, 1], or int8 uniform in -127..127."""
    if vector_type not in ("f32", "i8"):
        raise InvalidArgument(f"vector type {vector_type!r}")
    places = F.sequence(F.lit(0), F.lit(dim - 1))

    def component(i):
        h = F.xxhash64(F.lit(seed), F.col("key"), i)
        return (h / float(2**63)).cast("float") if vector_type == "f32" else (F.pmod(h, F.lit(255)) - 127).cast("tinyint")

    return spark.range(n).select(F.col("id").alias("key"), F.transform(places, component).alias("vector"))
