import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.errors import AlreadyExists, Corrupt, InvalidArgument, NotFound, StoreError
from siltstone.functions import generate
from siltstone.plans.query import Options
from siltstone.sources.schema import Field, Schema
from siltstone.sources.table import VectorTable
from siltstone.streaming import changelog

SCHEMA = Schema(4, (Field("i", "int"), Field("f", "float"), Field("s", "string")))


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def keys(table, text=None, **kw):
    return [bytes(r.key).decode() for r in table.query(text, **kw).collect()]


def test_lifecycle(spark, path, tmp_path):
    with pytest.raises(NotFound):
        VectorTable.open(spark, path)
    assert not (tmp_path / "db").exists()
    t = VectorTable.create(spark, path, SCHEMA)
    with pytest.raises(AlreadyExists):
        VectorTable.create(spark, path, SCHEMA)
    assert keys(t, "i == 1") == [] and (t.dim, t.vector_type) == (4, "f32")
    t.put("k0", "the_value", [0.1, 0.2, 0.3, 0.4], {"i": 42, "f": 1.5, "s": "hello"})
    other = VectorTable.open(spark, path)
    other.put("k1", "x")
    with pytest.raises(Corrupt):  # the first handle has fallen behind
        t.put("k2", "y")
    other.close()
    other.close()
    with pytest.raises(StoreError):
        other.put("k3")
    again = VectorTable.open(spark, path)
    row = again.get("k0")
    assert (row.value, row.i, row.f, row.s, row.vector_id) == (b"the_value", 42, 1.5, "hello", 0)
    assert again.manifest.base and not again.manifest.deltas and again.manifest.next_seq == 3


def test_crud_keeps_what_it_should(spark, path):
    t = VectorTable.create(spark, path, SCHEMA)
    t.put("a", "v", [1, 2, 3, 4], {"i": 1, "s": "x"})
    t.update_value("a", "w")
    row = t.get("a")
    assert (row.value, row.vector, row.vector_id, row.i, row.s) == (b"w", [1, 2, 3, 4], 0, 1, "x")
    t.update_field("a", {"i": 9, "f": 2.5})
    row = t.get("a")
    assert (row.i, row.f, row.s, row.vector) == (9, 2.5, "x", [1, 2, 3, 4])
    assert keys(t, "i == 1") == [] and keys(t, "i == 9") == ["a"]
    t.update_vector("a", [0, 0, 0, 1])
    assert t.get("a").vector_id == 1 and t.get("a").vector == [0, 0, 0, 1]
    t.put("a", "only")
    row = t.get("a")
    assert (row.value, row.vector, row.i, row.s) == (b"only", None, None, None)
    t.delete("a")
    assert t.get("a") is None
    for call in (lambda: t.delete("a"), lambda: t.update_value("a", "x"), lambda: t.update_field("zz", {"i": 1})):
        with pytest.raises(NotFound):
            call()
    for call in (lambda: t.put("", "x"), lambda: t.put("k" * 1025), lambda: t.put("k", vector=[1]), lambda: t.put("k", fields={"no": 1}), lambda: t.put("k", fields={"i": "x"}), lambda: t.update_vector("a", None)):
        with pytest.raises(InvalidArgument):
            call()
    seq = t.put(None, "auto")
    assert t.get(seq.to_bytes(8, "big")).value == b"auto"


def test_newest_wins_after_compaction_and_reopen(spark, path):
    t = VectorTable.create(spark, path, SCHEMA, flush_threshold=4)
    for k in range(5):
        t.put(f"rec_{k}", f"v{k}", fields={"i": 555})
    assert t.manifest.base
    t.delete("rec_2")
    t.update_field("rec_1", {"i": 7})
    assert keys(t, "i == 555") == ["rec_0", "rec_3", "rec_4"]
    t.close()
    t = VectorTable.open(spark, path)
    assert keys(t, "i == 555") == ["rec_0", "rec_3", "rec_4"] and t.get("rec_2") is None
    assert t.changelog().count() == 4


def test_batches(spark, path):
    t = VectorTable.create(spark, path, SCHEMA, flush_threshold=10_000)
    rng = random.Random(5)
    rows = [(f"key_{k % 150:03d}", f"value_{k}", [rng.uniform(-1, 1) for _ in range(4)] if k % 3 else None, rng.randint(-50, 100), k) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, value string, vector array<double>, i long, at long").repartition(5)
    assert t.put_many(df, order_by="at") == 200
    log = t.changelog().orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, 201)) and [bytes(r.value).decode() for r in log] == [r[1] for r in rows]
    assert [r.vector_id for r in log if r.vector_id is not None] == list(range(sum(r[2] is not None for r in rows)))
    last = {r[0]: r for r in rows}
    assert keys(t, "i < 55 AND i > 0") == sorted(k for k, r in last.items() if 0 < r[3] < 55)
    q = next(r for r in rows if r[2] and r[0] not in {x[0] for x in rows[150:]})
    best = t.query(None, q[2], Options(order_by="vector", descending=True, limit=1)).first()
    assert bytes(best.key).decode() == q[0] and best.vector_score > 0.99
    assert t.delete_many(spark.createDataFrame([("key_000",), ("nope",), ("key_001",)], "key string")) == 2
    t.compact()
    assert t.current().count() == 148
    with pytest.raises(Exception, match="limits"):
        t.put_many(spark.createDataFrame([("", "x")], "key string, value string"))
    with pytest.raises(InvalidArgument):
        t.put_many(spark.createDataFrame([("a", "x")], "key string, nope string"))


def test_two_writers_one_fails(spark, path):
    t = VectorTable.create(spark, path, SCHEMA)
    a, b = VectorTable.open(spark, path), VectorTable.open(spark, path)
    a.put("k", "a")
    with pytest.raises(Corrupt):
        b.put("k", "b")
    a.flush()
    for call in (lambda: b.put("k", "b"), lambda: b.put_many(spark.createDataFrame([("x", "y")], "key string, value string")), lambda: t._publish(t.manifest)):
        with pytest.raises(Corrupt):
            call()
    assert VectorTable.open(spark, path).get("k").value == b"a"


def test_readers_keep_what_they_planned_on(spark, path):
    t = VectorTable.create(spark, path, SCHEMA)
    t.put_many(spark.createDataFrame([(f"k{i}", "v") for i in range(20)], "key string, value string"))
    before = t.current()
    t.compact()
    middle = t.current()
    t.put("k0", "new")
    t.compact()
    assert before.count() == middle.count() == 20 and {bytes(r.value) for r in before.collect()} == {b"v"}
    assert len([n for n in t.files.names("") if n.startswith("base-")]) == 2
    assert t.vacuum(retained=0, grace_ms=0) and len([n for n in t.files.names("") if n.startswith("base-")]) == 1 and t.current().count() == 20


def test_crashes_leave_nothing_wrong(spark, path, tmp_path):
    t = VectorTable.create(spark, path, SCHEMA)
    t.put("a", "1", [1, 2, 3, 4])
    t.flush()
    t.put("b", "2", [0.1, 2, 3, 4], {"i": 1})
    root = tmp_path / "db"
    (root / "_log" / f"{t.next_seq:020d}.json").write_text('{"crc": 1, "se')
    (root / "_manifest" / f"{t.manifest.number + 1:08d}.json").write_text('{"crc": 1')
    for name in ("delta-lost", "base-lost", "_staged-lost"):
        (root / name).mkdir()
    t = VectorTable.open(spark, path)
    assert keys(t) == ["a", "b"] and t.get("b").vector_id == 1 and t.get("b").vector == pytest.approx([0.1, 2, 3, 4])
    seq = t.put("c", "3")
    t.flush()
    t = VectorTable.open(spark, path)
    assert seq == 3 and keys(t) == ["a", "b", "c"] and t.current().where("vector is not null").count() == 2
    assert {n for n in t.vacuum(grace_ms=0) if "lost" in n} == {"delta-lost", "base-lost", "_staged-lost"} and keys(t) == ["a", "b", "c"]
    text = (root / "_manifest" / f"{t.manifest.number:08d}.json").read_text()
    (root / "_manifest" / f"{t.manifest.number:08d}.json").write_text(text.replace('"next_seq": 4', '"next_seq": 9'))
    assert VectorTable.open(spark, path).manifest.next_seq < 9


def test_late_rows_never_win(spark, path, tmp_path):
    t = VectorTable.create(spark, path, SCHEMA)
    batches = [[(9, "PUT", "k", "new"), (5, "PUT", "d", "x")], [(8, "DELETE", "d", None), (4, "PUT", "k", "old")], [(6, "PUT", "d", "late"), (9, "PUT", "k", "new")], [(12, "UPDATE", "u", "whole")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "seq long, op string, key string, value string").selectExpr("seq", "op", "cast(key as binary) key", "cast(value as binary) value").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        changelog.ingest(changelog.changes(spark, f"{tmp_path}/in/*", t), t, f"{tmp_path}/checkpoint").awaitTermination()
        if n == 1:
            t.compact()
    assert keys(t) == ["k", "u"] and t.get("k").value == b"new" and t.get("d") is None
    t.compact()
    assert keys(t) == ["k", "u"] and t.put("z", "1") == 13 and keys(VectorTable.open(spark, path)) == ["k", "u", "z"]


@pytest.mark.parametrize("dim", [8, 100])
def test_index_recall_pruning_and_upkeep(spark, path, dim):
    t = VectorTable.create(spark, path, Schema(dim, (Field("i", "int"),)), flush_threshold=10**6)
    rows = generate.vectors(spark, 600, dim, seed=dim).select(F.lpad(F.col("key").cast("string"), 6, "0").alias("key"), "vector", (F.col("key") % 10).alias("i"))
    t.put_many(rows)
    t.create_index(cells=8, probes=6)
    t = VectorTable.open(spark, path)
    assert t.manifest.base_index and t.current().count() == 600
    hits, near = 0, Options(order_by="vector", descending=True, limit=10)
    for r in rows.where("key % 100 = 0").collect():
        wanted = {bytes(x.key) for x in t.query(None, r.vector, near).collect()}
        hits += len(wanted & {bytes(x.key) for x in t.query_near(r.vector).collect()})
    assert hits >= 48
    plan = t.query_near(rows.first().vector)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    t.put("000000", None, [0.5] * dim, {"i": 77})
    t.delete("000001")
    t.put("extra", None, [0.5] * dim, {"i": 1})
    for table in (t, VectorTable.open(spark, path)):
        best = [bytes(x.key).decode() for x in table.query_near([0.5] * dim, "i >= 0").collect()]
        assert best[:2] == ["000000", "extra"] and "000001" not in best
    t.compact()
    assert [bytes(x.key).decode() for x in t.query_near([0.5] * dim, "i >= 0").collect()][:2] == ["000000", "extra"] and t.manifest.base_index == t.manifest.index


def test_single_puts_need_no_job(spark, path):
    t = VectorTable.create(spark, path, SCHEMA, flush_threshold=10_000)
    began = time.time()
    for i in range(200):
        t.put(f"k{i:03d}", "v", [1, 2, 3, 4], {"i": i})
    assert time.time() - began < 10 and not t.manifest.deltas and t.get("k007").i == 7 and len(keys(VectorTable.open(spark, path), "i < 50")) == 50


def test_generated_vectors(spark):
    a = {r.key: r.vector for r in generate.vectors(spark, 200, 16, 5).collect()}
    b = {r.key: r.vector for r in generate.vectors(spark, 200, 16, 5).repartition(7).collect()}
    flat = [x for v in a.values() for x in v]
    assert a == b and min(flat) < -0.95 and max(flat) > 0.95 and abs(sum(flat) / len(flat)) < 0.05 and all(-1 <= x <= 1 for x in flat)
    assert {x for r in generate.vectors(spark, 500, 16, 5, "i8").collect() for x in r.vector} >= {-127, 0, 127}


def test_stream(spark, path, tmp_path):
    t = VectorTable.create(spark, path, SCHEMA)
    kind = SCHEMA.changelog()
    for n, rows in enumerate(([(1, "PUT", b"a", b"1", None, None, 1, None, None), (2, "PUT", b"b", b"2", None, None, 2, None, None)], [(3, "DELETE", b"a", None, None, None, None, None, None), (4, "PUT", b"b", b"3", None, None, 3, None, None)])):
        spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        changelog.ingest(changelog.changes(spark, f"{tmp_path}/in/*", t), t, f"{tmp_path}/checkpoint").awaitTermination()
    assert keys(t) == ["b"] and t.get("b").i == 3
