"""Filter, score, threshold, order, limit: one query as one DataFrame.

``plan`` is a pure function from DataFrame to DataFrame and works on any records, stored or not.
The filter stands directly on the scan, so it reaches Parquet; the vector column is read only if the query scores; an order
with a limit is planned as a top-k, without a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidQuery, UnsupportedQueryOp
from ..functions import distance
from ..sources.schema import FIELD_TYPES, METRICS, Field, Schema
from .predicate import compile_filter

RESULT = ("node_seq", "vector_id", "key", "value", "vector_score")


@dataclass(frozen=True)
class Options:
    limit: int = 0  #: 0: all
    order_by: str | None = None  #: an int or float field, or "vector"
    descending: bool = False
    score: float | None = None  #: a threshold; ignored without a query vector
    bound: str = "above"  #: above (>=) or below (<=)
    metric: str | None = None  #: None: the schema's
    strict: bool = False  #: an empty filter raises
    ordered: bool = True  #: without an order and a limit, still sort by key; False saves that sort

    def __post_init__(self) -> None:
        if self.limit < 0 or self.bound not in ("above", "below") or self.metric not in (None, *METRICS):
            raise InvalidArgument(f"options: {self}")


def plan(records: DataFrame, schema: Schema, filter: str | None = None, vector: Sequence[float] | None = None, options: Options = Options(), extra: Sequence[str] = ()) -> DataFrame:  # noqa: A002
    """``records`` has the columns key, value, seq, vector_id, vector and the schema's fields."""
    by_vector = options.order_by is not None and options.order_by.lower() == "vector"
    if by_vector and vector is None:
        raise InvalidQuery("ordering by vector needs a query vector")
    by_field = None
    if options.order_by is not None and not by_vector:
        by_field = schema.field(options.order_by)
        if by_field is None:
            raise InvalidQuery(f"no field {options.order_by!r}")
        if by_field.kind == "string":
            raise UnsupportedQueryOp(f"{by_field.name} is a string; strings have no order")
    searches = vector is not None and (by_vector or options.score is not None)

    out = records.where(compile_filter(filter, schema, options.strict))
    if searches:
        query = distance.literal(schema.check_vector(vector), schema.vector_type)
        metric = options.metric or schema.metric
        out = out.where(F.col("vector").isNotNull()).withColumn("vector_score", distance.score(F.col("vector"), query, metric, schema.vector_type))
        if options.score is not None:
            score = F.col("vector_score")
            out = out.where(score >= options.score if options.bound == "above" else score <= options.score)
    else:
        out = out.withColumn("vector_score", F.lit(0.0))
    if options.ordered or options.limit or by_vector or by_field:
        out = out.orderBy(*_order("vector_score" if by_vector else by_field.name if by_field else None, options.descending))
    if options.limit:
        out = out.limit(options.limit)
    return out.select(F.col("seq").alias("node_seq"), "vector_id", "key", "value", "vector_score", *extra)


def _order(name: str | None, descending: bool) -> list[Column]:
    """Ties, and results without an order, go by key."""
    if name is None:
        return [F.col("key").asc()]
    column = F.col(f"`{name}`")
    return [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col("key").asc()]


def as_records(df: DataFrame, key: str, fields: dict[str, str], vector: str | None = None, value: str | None = None, dim: int = 1, metric: str = "l2", vector_type: str = "f32") -> tuple[DataFrame, Schema]:
    """Any table as records: ``fields`` maps column names to int, float or string; the key keeps its type and order."""
    schema = Schema(dim, tuple(Field(n, k) for n, k in fields.items()), vector_type, metric)
    columns = [
        F.col(key).alias("key"),
        (F.col(value).cast("string") if value else F.lit(None)).cast("binary").alias("value"),
        F.lit(None).cast("long").alias("seq"),
        F.lit(None).cast("long").alias("vector_id"),
        (F.col(vector) if vector else F.lit(None).cast(f"array<{schema.element.simpleString()}>")).alias("vector"),
    ]
    return df.select(*columns, *[F.col(n).cast(FIELD_TYPES[k]).alias(n) for n, k in fields.items()]), schema
