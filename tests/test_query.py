import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone import catalogue
from siltstone.errors import InvalidArgument, InvalidQuery, UnsupportedQueryOp
from siltstone.functions import distance
from siltstone.operators import ann, batch, metrics, versions
from siltstone.plans.query import Options, as_records, plan


def records(spark, n=60, dim=8, vector_type="f32", metric="l2", seed=3):
    rng = random.Random(seed)
    draw = (lambda: rng.randint(-127, 127)) if vector_type == "i8" else (lambda: rng.uniform(-1, 1))
    rows = [(k, [draw() for _ in range(dim)] if k % 7 else None, rng.randint(0, 9), rng.uniform(-10, 10)) for k in range(n)]
    kind = "tinyint" if vector_type == "i8" else "float"
    df = spark.createDataFrame(rows, f"k int, v array<{kind}>, i long, f double")
    return *as_records(df, "k", {"i": "int", "f": "float"}, vector="v", dim=dim, metric=metric, vector_type=vector_type), rows


@pytest.mark.parametrize("vector_type", ["f32", "i8"])
@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("dim", [3, 8, 100])
def test_scores_equal_brute_force(spark, vector_type, metric, dim):
    df, schema, rows = records(spark, 40, dim, vector_type, metric)
    q = rows[1][1]
    got = plan(df, schema, None, q, Options(order_by="vector", descending=True)).collect()
    kind = np.float32 if vector_type == "f32" else np.int64
    a = np.array(q, kind).astype(np.float64)
    expected = {}
    for k, v, *_ in rows:
        if v is not None:
            b = np.array(v, kind).astype(np.float64)
            expected[k] = 1 / (1 + ((a - b) ** 2).sum()) if metric == "l2" else float(1 / (1 + np.exp(-0.01 * (a * b).sum())))
    assert {r.key: pytest.approx(r.vector_score, rel=1e-9) for r in got} == expected
    assert [r.vector_score for r in got] == sorted((r.vector_score for r in got), reverse=True)
    if metric == "l2":
        assert got[0].key == 1 and got[0].vector_score == 1.0


def test_option_rules(spark):
    df, schema, rows = records(spark)
    q = rows[1][1]
    assert plan(df, schema, None, q, Options()).where("vector_score <> 0").count() == 0
    assert plan(df, schema, None, None, Options(score=0.5)).count() == 60
    above = plan(df, schema, None, q, Options(score=0.2)).count()
    below = plan(df, schema, None, q, Options(score=0.2, bound="below")).count()
    assert above + below == sum(v is not None for _, v, *_ in rows) and above and below
    assert [r.key for r in plan(df, schema, None, None, Options(limit=3)).collect()] == [0, 1, 2]
    assert plan(df, schema, None, None, Options(limit=100)).count() == 60
    by_f = plan(df, schema, None, q, Options(score=0.0, order_by="f", limit=5)).collect()
    assert [r.key for r in by_f] == [k for k, v, _, f in sorted(rows, key=lambda r: r[3]) if v is not None][:5]
    with pytest.raises(InvalidQuery):
        plan(df, schema, None, None, Options(order_by="Vector"))
    with pytest.raises(InvalidQuery):
        plan(df, schema, None, None, Options(order_by="none"))
    with pytest.raises(InvalidArgument):
        plan(df, schema, None, [1.0], Options(order_by="vector"))
    with pytest.raises(InvalidArgument):
        Options(limit=-1)
    text, text_schema = as_records(spark.createDataFrame([(1, "a")], "k int, s string"), "k", {"s": "string"})
    with pytest.raises(UnsupportedQueryOp):
        plan(text, text_schema, None, None, Options(order_by="s"))


def test_filter_reaches_the_scan_and_topk(spark, tmp_path):
    df, schema, rows = records(spark)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = plan(stored, schema, "i > 3", rows[1][1], Options(order_by="vector", descending=True, limit=3))
    text = found._jdf.queryExecution().toString()
    assert "GreaterThan(i,3)" in text and "TakeOrderedAndProject" in text
    scan = plan(stored, schema, "i > 3", None, Options(ordered=False))._jdf.queryExecution().executedPlan().toString()
    assert "vector#" not in scan.split("ReadSchema")[1]


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "PUT", 5), ("a", 4, "PUT", 1), ("b", 2, "PUT", 9), ("b", 5, "DELETE", None), ("c", 3, "PUT", 7)], "key string, seq long, op string, x int")
    assert {(r.key, r.x) for r in versions.current(log).collect()} == {("a", 1), ("c", 7)}
    assert versions.current(log).where("x > 4").count() == 1  # the old version of a doesn't come back
    base, delta = versions.current(log.where("seq < 4")), log.where("seq >= 4")
    assert {(r.key, r.x) for r in versions.merge(base, delta).collect()} == {("a", 1), ("c", 7)}
    gone = versions.delete(log, spark.createDataFrame([("c", 6), ("zz", 7)], "key string, seq long"))
    assert {r.key for r in versions.current(gone).collect()} == {"a"} and gone.count() == 6
    new = versions.update(log, spark.createDataFrame([("c", 6, 8), ("b", 7, 8)], "key string, seq long, x int"), ["x"])
    assert {(r.key, r.x) for r in versions.current(new).collect()} == {("a", 1), ("c", 8)}


def test_knn_both_ways_and_recall(spark):
    df, _, rows = records(spark, 50, 16)
    base = df.select("key", "vector")
    one = batch.knn_join(base.where("key < 9"), base, 4).orderBy("query_key", "rank").collect()
    two = batch.knn_join_sql(base.where("key < 9"), base, 4).orderBy("query_key", "rank").collect()
    assert [(r.query_key, r.rank, r.key) for r in one] == [(r.query_key, r.rank, r.key) for r in two] and len(one) == 4 * 7
    assert [r.distance for r in one] == [r.distance for r in two]
    assert all(r.query_key != r.key for r in batch.knn_join(base.where("key < 9"), base, 4, exclude_self=True).collect())
    truth, found = batch.knn_join(base, base, 4), batch.knn_join(base, base, 2)
    assert metrics.recall_at_k(truth, found, 4).first().recall == 0.5
    assert batch.knn_join(base.where("key < 0"), base, 4).count() == 0


def test_batch_search_by_columns_answers_every_query(spark):
    df, _, _ = records(spark, 1300, 2)
    base = df.select("key", "vector")
    one = {(r.query_key, r.rank): (r.key, r.distance) for r in batch.knn_join(base, base, 2).collect()}
    two = {(r.query_key, r.rank): (r.key, r.distance) for r in batch.knn_join_sql(base, base, 2).collect()}
    assert len(two) == 2 * sum(1 for k in range(1300) if k % 7) and one == two
    assert batch.knn_join_sql(base.where("key < 0"), base, 2).count() == 0


def test_latency_percentiles(spark):
    values = [float(x) for x in (5, 1, 4, 2, 3, 9, 8, 7, 6, 10, 10, None)[:-1]]
    r = metrics.latency_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (r.p50, r.p90) == (6.0, sorted(values)[int(0.9 * len(values)) - 1])


def test_percentiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(metrics, "HELD", 50)
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(5000)], [1.0] * 3000 + [rng.random() for _ in range(900)], [2.0] * 4000, [7.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        r = metrics.latency_percentiles(df, "v").first()
        assert (r.p50, r.p90) == (np.median(values), sorted(values)[max(int(0.9 * len(values)) - 1, 0)])
    assert metrics.latency_percentiles(df.limit(0), "v").first() == (None, None)


def test_cells_find_most(spark):
    df, schema, rows = records(spark, 300, 8)
    index = ann.CellIndex.fit(df, cells=8)
    assigned = index.assign(df)
    assert assigned.where("vector is null and cell is not null or vector is not null and cell is null").count() == 0
    options, hits = Options(order_by="vector", descending=True, limit=10), 0
    for k in (1, 2, 3, 4):
        truth = {r.key for r in plan(df, schema, None, rows[k][1], options).collect()}
        hits += len(truth & {r.key for r in index.search(assigned, schema, None, rows[k][1], options, probes=5).collect()})
    assert hits >= 32
    assert index.search(assigned, schema, None, rows[1][1], options, probes=8).count() == 10


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_search_of_cells_sends_the_best_rows_not_all_pairs(spark, metric):
    df, _, _ = records(spark, 3000, 4, metric=metric)
    df = df.select(F.lpad(F.col("key").cast("string"), 5, "0").alias("key"), "vector")
    df = df.union(df.where("key < '00040'").select(F.concat("key", F.lit("x")), "vector")).repartition(5)  # copies: ties go by the key
    index = ann.CellIndex.fit(df, cells=6)
    assigned, asked = index.assign(df), df.where("substring(key, 1, 5) % 50 = 1 or key = '00003x'")
    found = index.knn_join(asked, assigned, 5, metric, probes=3)
    plan_ = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan_ and "Generate" not in plan_ and plan_.count("Exchange hashpartitioning") == 1
    rows, expected = [r for r in assigned.collect() if r.vector], {}
    x = np.array([r.vector for r in rows], np.float64)
    for r in asked.where("vector is not null").collect():
        probed, q = index.probes(r.vector, 3), np.array(r.vector, np.float64)
        d = batch._distances(np.tile(q, (len(x), 1)), x, metric).tolist()
        expected[r.key] = sorted((e, row.key) for e, row in zip(d, rows, strict=True) if row.cell in probed)[:5]
    got: dict = {}
    for r in found.orderBy("query_key", "rank").collect():
        got.setdefault(r.query_key, []).append((r.distance, r.key))
    assert got == expected and len(got) > 50
    assert index.knn_join(df.where("key < '0'"), assigned, 5, metric).count() == 0


def test_copies_are_compared_k_times_a_tile(monkeypatch):
    compared = []
    monkeypatch.setattr(batch, "_distances", lambda q, r, metric, f=batch._distances: compared.append(len(q)) or f(q, r, metric))
    same, other = [0.5] * 8, [0.25] * 8
    rows = pa.RecordBatch.from_arrays([pa.array(range(4096, 0, -1)), pa.array([same] * 4000 + [other] * 96, pa.list_(pa.float32()))], names=["key", "vector"])
    kinds = pa.schema([("query_key", pa.int64()), ("key", pa.int64()), ("distance", pa.float64())])
    (out,) = batch._best(list(range(30)), np.array([same] * 30), "l2", 5, kinds)(iter([rows]))
    assert {q: [r["key"] for r in out.to_pylist() if r["query_key"] == q] for q in range(30)} == {q: [97, 98, 99, 100, 101] for q in range(30)}
    assert sum(compared) <= 30 * 2 * 10


def test_fit_orders_few_more_rows_than_its_sample(spark, monkeypatch):
    df, _, _ = records(spark, 4000, 4)
    ordered, wanted = [], df.where("vector is not null").select("vector").orderBy(F.xxhash64("vector")).limit(100).collect()
    monkeypatch.setattr(type(df), "orderBy", lambda self, *by, f=type(df).orderBy: ordered.append(self.count()) or f(self, *by))
    index = ann.CellIndex.fit(df, cells=8, sample=100)
    assert sum(ordered) < 1000
    monkeypatch.undo()
    assert (index.centroids == ann.CellIndex.fit(spark.createDataFrame(wanted, "vector array<float>"), cells=8, sample=100).centroids).all()
    some = df.select(F.when(F.col("key") % 100 > 0, F.array(F.lit(1.0))).otherwise(F.slice("vector", 1, 1).cast("array<double>")).alias("vector")).where("vector is not null")  # copies outside the lowest part
    assert len(ann._sample(some, 100)) == 100 and ann._sample(some, 100) == some.orderBy(F.xxhash64("vector")).limit(100).collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_cells_find_nine_of_ten(spark, sf, monkeypatch):
    used = []
    monkeypatch.setattr(ann.CellIndex, "search", lambda self, assigned, schema, text, vector, options, probes=8, f=ann.CellIndex.search: used.append((self, assigned, probes)) or f(self, assigned, schema, text, vector, options, probes))
    assert catalogue.ann_cells(spark, f"/root/testdata/{sf}").count() == 10
    index, assigned, probes = used[0]
    rows = assigned.select("key", "vector", "cell").collect()
    keys, x, cells = np.array([r.key for r in rows]), np.array([r.vector for r in rows], np.float64), np.array([r.cell for r in rows])
    recall = [np.isin(cells[np.lexsort((keys, ((x - q) ** 2).sum(1)))[:10]], index.probes(q, probes)).mean() for q in x[keys % 50 == 0]]
    assert len(recall) == len(rows) // 50 and np.mean(recall) >= 0.9


def test_quantise_and_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.n for r in df.select(distance.normalise(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r.q for r in df.select(distance.quantise(F.col("v"), 100).alias("q")).collect()] == [[127, 127], [0, 0]]
    assert distance.fnv1a(b"") == 0xCBF29CE484222325 and distance.fnv1a(b"a") == 0xAF63DC4C8601EC8C
