"""Recall of one result against another, and latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may come to the driver, and the steps of a narrowing pass.
HELD, STEPS = 20_000, 200


def recall_at_k(truth: DataFrame, found: DataFrame, k: int, query: str = "query_key", key: str = "key") -> DataFrame:
    """One row: recall, the hits among each query's k true rows, over k, on average."""
    hits = found.select(query, key).distinct().withColumn("hit", F.lit(1))
    by_query = truth.select(query, key).distinct().join(hits, [query, key], "left").groupBy(query).agg((F.count("hit") / F.lit(k)).alias("r"))
    return by_query.agg(F.avg("r").alias("recall"))


def value_at(df: DataFrame, value: str, rank: int) -> float:
    """The value of that rank (from 1), exactly. Approximate quantiles are edges, an aggregate counts what is below and at each of them, and
    what lies between the two around the rank is cut again until it is few rows or one value; so no task sorts all values."""
    v = F.col(value)
    some = df.where(v.isNotNull()).select(v)
    while True:
        n, least, most = some.agg(F.count("*"), F.min(v), F.max(v)).first()
        if least == most:
            return least
        if n <= HELD:
            return sorted(r[0] for r in some.collect())[rank - 1]
        edges = sorted(set(some.agg(F.percentile_approx(v, [i / STEPS for i in range(1, STEPS)], 10 * STEPS)).first()[0]))
        counts = some.agg(*[c for i, e in enumerate(edges) for c in (F.count_if(v < e).alias(f"b{i}"), F.count_if(v <= e).alias(f"c{i}"))]).first()
        i = next((i for i in range(len(edges)) if counts[2 * i + 1] >= rank), len(edges))
        if i < len(edges) and counts[2 * i] < rank:
            return edges[i]
        if i < len(edges):
            some = some.where(v < edges[i])
        if i:
            some, rank = some.where(v > edges[i - 1]), rank - counts[2 * i - 1]


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """One row: p50 (the median) and p90 (the element at 0.9 n - 1, rounded down, of the sorted list); both null without values."""
    n = df.where(F.col(value).isNotNull()).count()
    found = (None, None)
    if n:
        low, high = value_at(df, value, (n + 1) // 2), value_at(df, value, n // 2 + 1)
        found = ((low + high) / 2, float(value_at(df, value, max(n * 9 // 10, 1))))
    return df.sparkSession.createDataFrame([found], "p50 double, p90 double")
