"""A table of versioned records on any file system that Spark reaches.

    <path>/_manifest/<number>.json   schema, counters, the snapshot and the deltas; the highest sound number counts
    <path>/_log/<seq>.json           records written one by one since the manifest
    <path>/base-<id>/                compacted records, one version a key, in key order; by cell where there is an index
    <path>/delta-<id>/               changes since then

A write of many rows adds a delta and then a manifest of the next number; a single record is a small file named by its sequence number, without
a Spark job, and ``flush_threshold`` of them become a delta. Both kinds of files are created only if they aren't there yet, so of two writers
one fails with ``Corrupt``, and carry a checksum, so readers see all of a write or nothing: a torn file at the end is passed over.
Where there are no changes since the base, a query reads it without a newest-version pass, so that filters reach Parquet.

What a manifest no longer names stays for the ``RETAINED`` manifests after it, for those who still read it; ``vacuum`` deletes it then, and
what a crash left behind once it is ``GRACE_MS`` old.
"""

from __future__ import annotations

import base64
import json
import os
import time
import uuid
import zlib
from array import array
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, Corrupt, InvalidArgument, NotFound, StoreError
from ..operators import versions
from ..operators.ann import CellIndex
from ..plans import query as plans
from ..plans.predicate import comparisons, parse
from .schema import Schema, to_key, to_value

FLUSH_THRESHOLD = 1024
RETAINED, GRACE_MS = 20, 24 * 3600 * 1000


def sealed(data: dict) -> str:
    """JSON with a checksum over the rest of it."""
    return json.dumps(data | {"crc": _crc(data)}, sort_keys=True)


def unsealed(text: str) -> dict:
    try:
        data = json.loads(text)
        crc = data.pop("crc")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Corrupt(f"not a whole file: {e}") from e
    if crc != _crc(data):
        raise Corrupt("the checksum differs")
    return data


def _crc(data: dict) -> int:
    return zlib.crc32(json.dumps(data, sort_keys=True).encode())


@dataclass(frozen=True)
class Manifest:
    number: int
    schema: Schema
    next_seq: int = 1
    next_vector_id: int = 0
    base: str | None = None
    deltas: tuple[str, ...] = ()
    delta_rows: int = 0
    index: str | None = None  #: the file of the cell index
    base_index: str | None = None  #: the one by which the base is laid out
    probes: int = 0
    tombstones: bool = False  #: whether compaction keeps them, for rows that come late

    def to_json(self) -> str:
        return sealed(self.__dict__ | {"schema": self.schema.to_json(), "deltas": list(self.deltas), "format": 2})

    @staticmethod
    def from_json(text: str) -> Manifest:
        data = unsealed(text)
        if data.pop("format", None) != 2:
            raise Corrupt("another manifest format")
        try:
            return Manifest(**data | {"schema": Schema.from_json(data["schema"]), "deltas": tuple(data["deltas"])})
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt(f"manifest: {e}") from e


class _Files:
    """Small files by Hadoop's file systems, which all of Spark's paths have."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        #: The folder on the driver's own or mounted disk, where it is one.
        self.local = urlsplit(self.path("").toUri().toString()).path if self.fs.getScheme() == "file" else None

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def create(self, name: str, text: str) -> None:
        """Fails if there is one: exclusively where the file system is local, else as its create without overwrite does it."""
        raw = text.encode()
        if self.local is not None:
            local = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                with open(local, "xb") as out:
                    out.write(raw)
            except FileExistsError as e:
                raise Corrupt(f"{name} was written by another writer") from e
            return
        path = self.path(name)
        try:
            out = self.fs.create(path, False)
            out.write(bytearray(raw))
            out.close()
        except Exception as e:
            if self.fs.exists(path):
                raise Corrupt(f"{name} was written by another writer") from e
            raise

    def exists(self, name: str) -> bool:
        return os.path.exists(f"{self.local}/{name}") if self.local is not None else self.fs.exists(self.path(name))

    def modified(self, name: str) -> int:
        return self.fs.getFileStatus(self.path(name)).getModificationTime()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, flush_threshold: int = FLUSH_THRESHOLD) -> None:
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.flush_threshold, self.files, self.open_ = flush_threshold or FLUSH_THRESHOLD, _Files(spark, path), True
        self.recent: list[dict] = []  # records written one by one since the manifest, in order
        self.newest: dict[bytes, dict] = {}
        self.next_vector_id = manifest.next_vector_id
        self._recover()

    # lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: Schema, flush_threshold: int = 0) -> VectorTable:
        files = _Files(spark, path)
        if files.names("_manifest"):
            raise AlreadyExists(path)
        manifest = Manifest(0, schema)
        files.create("_manifest/00000000.json", manifest.to_json())
        return cls(spark, path, manifest, flush_threshold)

    @classmethod
    def open(cls, spark: SparkSession, path: str, flush_threshold: int = 0) -> VectorTable:
        """The newest manifest that is whole; what a crash left unfinished is passed over."""
        files = _Files(spark, path)
        numbers = sorted((n for n in files.names("_manifest") if n.endswith(".json")), reverse=True)
        if not numbers:
            raise NotFound(path)
        for k, name in enumerate(numbers):
            try:
                manifest = Manifest.from_json(files.read(f"_manifest/{name}"))
            except Corrupt:
                if k == len(numbers) - 1:
                    raise
                continue
            # a torn file keeps its number
            return cls(spark, path, replace(manifest, number=int(numbers[0].removesuffix(".json"))), flush_threshold)
        raise NotFound(path)

    def _recover(self) -> None:
        """Reads the records that were written one by one since the manifest, up to a torn one."""
        for name in sorted(n for n in self.files.names("_log") if n.endswith(".json")):
            if int(name.removesuffix(".json")) != self.next_seq:
                if int(name.removesuffix(".json")) > self.next_seq:
                    break
                continue
            try:
                self._remember(_row_from(unsealed(self.files.read(f"_log/{name}"))))
            except Corrupt:
                self.files.delete(f"_log/{name}")
                break

    def _remember(self, row: dict) -> None:
        self.recent.append(row)
        self.newest[row["key"]] = row
        if row["vector_id"] is not None:
            self.next_vector_id = max(self.next_vector_id, row["vector_id"] + 1)

    @property
    def next_seq(self) -> int:
        return self.manifest.next_seq + len(self.recent)

    def close(self) -> None:
        """Compacts what is pending; closing twice does nothing."""
        if self.open_ and (self.manifest.deltas or self.recent):
            self.compact()
        self.open_ = False

    def __enter__(self) -> VectorTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def schema(self) -> Schema:
        return self.manifest.schema

    @property
    def dim(self) -> int:
        return self.schema.dim

    @property
    def vector_type(self) -> str:
        return self.schema.vector_type

    # reading

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema.changelog())
        return self.spark.read.schema(self.schema.changelog()).parquet(*paths).select(self.schema.changelog().names)  # without the cell

    def _memory(self) -> list[DataFrame]:
        if not self.recent:
            return []
        names = self.schema.changelog().names
        rows = [tuple(bytearray(x) if isinstance(x := r.get(n), bytes) else x for n in names) for r in self.recent]
        return [self.spark.createDataFrame(rows, self.schema.changelog())]

    def _changes(self) -> list[DataFrame]:
        """What was written since the base."""
        return ([self._read(self.manifest.deltas)] if self.manifest.deltas else []) + self._memory()

    def changelog(self) -> DataFrame:
        """All versions that are kept, tombstones among them."""
        self._check_open()
        out = self._read([self.manifest.base] if self.manifest.base else [])
        for more in self._changes():
            out = out.union(more)
        return out

    def current(self) -> DataFrame:
        """The newest version of every live key."""
        self._check_open()
        if self.manifest.base and not self.manifest.deltas and not self.recent:
            return self.changelog().where("op <> 'DELETE'") if self.manifest.tombstones else self.changelog()
        return versions.current(self.changelog())

    def get(self, key: bytes | str) -> Row | None:
        """node_seq, value, vector_id, vector and the fields of a live key; None for others."""
        self._check_open()
        raw = to_key(key)
        d = self.newest.get(raw)
        if d is None:
            stored = self._read([*([self.manifest.base] if self.manifest.base else []), *self.manifest.deltas])
            rows = stored.where(F.col("key") == F.lit(bytearray(raw))).orderBy(F.desc("seq")).limit(1).collect()
            if not rows:
                return None
            d = rows[0].asDict()
        if d["op"] == "DELETE":
            return None
        d = {n: d.get(n) for n in self.schema.changelog().names}
        d["node_seq"] = d.pop("seq")
        d["value"], d["key"] = bytes(d["value"]), bytes(d["key"])
        d.pop("op")
        return Row(**d)

    def query(self, filter: str | None = None, vector: Sequence[float] | None = None, options: plans.Options = plans.Options(), extra: Sequence[str] = ()) -> DataFrame:  # noqa: A002
        return plans.plan(self.current(), self.schema, filter, vector, options, extra)

    def query_near(self, vector: Sequence[float], filter: str | None = None, options: plans.Options = plans.Options(order_by="vector", descending=True, limit=10), extra: Sequence[str] = (), probes: int = 0) -> DataFrame:  # noqa: A002
        """The same, approximately, by the index: of the base only the cells nearest to the query are read (more for a filter with more
        comparisons), changes since then are all searched. Without an index, exactly."""
        m = self.manifest
        if not m.base_index:
            return self.query(filter, vector, options, extra)
        self._check_open()
        index = self._index(m.base_index)
        n = index.widened(probes or m.probes, comparisons(parse(filter, self.schema)))
        kind = T.StructType([*self.schema.changelog().fields, T.StructField("cell", T.IntegerType())])
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/{m.base}").where(F.col("cell").isin(index.probes(vector, n))).drop("cell")
        changes = self._changes()
        for more in changes:
            rows = rows.union(more)
        rows = versions.current(rows) if changes else rows.where("op <> 'DELETE'")
        return plans.plan(rows, self.schema, filter, vector, options, extra)

    def create_index(self, cells: int = 64, probes: int = 16, sample: int = 20_000) -> None:
        """Fits a cell index on a bounded sample of the live vectors and lays the base out by it; compactions keep to it."""
        self._check_open()
        index = CellIndex.fit(self.current(), cells, sample)
        name = f"_index-{uuid.uuid4().hex}.json"
        self.files.create(name, sealed({"centroids": index.to_json()}))
        self.flush()
        self._publish(replace(self.manifest, index=name, probes=min(probes, len(index.centroids))))
        self.compact()

    def _index(self, name: str) -> CellIndex:
        return CellIndex.from_json(unsealed(self.files.read(name))["centroids"])

    # writing, one record

    def put(self, key: bytes | str | None, value: bytes | str | None = None, vector: Sequence[float] | None = None, fields: dict[str, object] | None = None) -> int:
        """Replaces the whole record. Without a key, the sequence number is the key, in eight bytes, big end first."""
        raw = self.next_seq.to_bytes(8, "big") if key is None else to_key(key)
        return self._append("PUT", raw, to_value(value), None if vector is None else self.schema.check_vector(vector), self._fields(fields))

    def update_value(self, key: bytes | str, value: bytes | str | None) -> int:
        return self._update(key, value=to_value(value))

    def update_vector(self, key: bytes | str, vector: Sequence[float]) -> int:
        if vector is None:
            raise InvalidArgument("no vector")
        return self._update(key, vector=self.schema.check_vector(vector), new_vector=True)

    def update_field(self, key: bytes | str, fields: dict[str, object]) -> int:
        """Sets or adds fields; others stay."""
        return self._update(key, **self._fields(fields))

    def delete(self, key: bytes | str) -> int:
        self._live(key)
        return self._append("DELETE", to_key(key), None, None, {})

    def _fields(self, fields: dict[str, object] | None) -> dict[str, object]:
        out = {}
        for name, value in (fields or {}).items():
            field = self.schema.field(name)
            if field is None:
                raise InvalidArgument(f"no field {name!r}")
            out[name] = field.check(value)
        return out

    def _live(self, key: bytes | str) -> Row:
        row = self.get(key)
        if row is None:
            raise NotFound(repr(key))
        return row

    def _update(self, key: bytes | str, new_vector: bool = False, **changes: object) -> int:
        old = self._live(key).asDict()
        row = {n: old[n] for n in ("value", "vector", "vector_id", *(f.name for f in self.schema.fields))} | changes
        vector_id = None if new_vector else row["vector_id"]
        return self._append("UPDATE", to_key(key), row["value"], row["vector"], {f.name: row[f.name] for f in self.schema.fields}, vector_id)

    def _append(self, op: str, key: bytes, value: bytes | None, vector: list | None, fields: dict[str, object], vector_id: int | None = None) -> int:
        """A small file, without a Spark job."""
        self._check_open()
        if vector is not None and vector_id is None:
            vector_id = self.next_vector_id
        if vector is not None and self.vector_type == "f32":
            vector = array("f", vector).tolist()
        row = {"seq": self.next_seq, "op": op, "key": key, "value": value, "vector_id": vector_id, "vector": vector} | fields
        name = f"_log/{row['seq']:020d}.json"
        self.files.create(name, sealed(_row_to(row)))
        if self.files.exists(f"_manifest/{self.manifest.number + 1:08d}.json"):
            self.files.delete(name)
            raise Corrupt("another writer has written a manifest")
        self._remember(row)
        if len(self.recent) >= self.flush_threshold:
            self.flush()
        return row["seq"]

    def flush(self) -> None:
        """The records written one by one become a delta."""
        if self.recent:
            (rows,), n, seq, vid = self._memory(), len(self.recent), self.next_seq, self.next_vector_id
            names = [f"_log/{r['seq']:020d}.json" for r in self.recent]
            self._commit(rows.coalesce(1), n, seq, vid)
            for name in names:
                self.files.delete(name)

    # writing, many records

    def put_many(self, rows: DataFrame, order_by: str | None = None, op: str = "PUT") -> int:
        """Puts all rows (key, value, vector, fields; absent columns are absent in the records), the later of one key being its newest
        version: by ``order_by``, or in the order in which the rows come. Returns how many."""
        self._check_open()
        self.flush()
        rows = self._prepared(rows, order_by)
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        if order_by:
            rows = rows.repartitionByRange(F.col("_order")).sortWithinPartitions("_order")
        rows.withColumn("_part", F.spark_partition_id()).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        counts = held.groupBy("_part").agg(F.count("*").alias("n"), F.count("vector").alias("v")).orderBy("_part").collect()  # a row a task
        bases, n, v = [], 0, 0
        for r in counts:
            bases.append((r["_part"], self.manifest.next_seq + n, self.manifest.next_vector_id + v))
            n, v = n + r.n, v + r.v
        within = Window.partitionBy("_part").orderBy("_order")
        offsets = self.spark.createDataFrame(bases, "_part int, _seq long, _vid long")
        numbered = held.join(F.broadcast(offsets), "_part").withColumns(
            {
                "seq": F.col("_seq") + F.row_number().over(within) - 1,
                "op": F.lit(op),
                "vector_id": F.when(F.col("vector").isNotNull(), F.col("_vid") + F.count("vector").over(within.rowsBetween(Window.unboundedPreceding, 0)) - 1),
            }
        )
        if n:
            self._commit(numbered, n, self.manifest.next_seq + n, self.manifest.next_vector_id + v)
        self.files.delete(staged.removeprefix(f"{self.path}/"))
        return n

    def _prepared(self, rows: DataFrame, order_by: str | None) -> DataFrame:
        """Checked columns of the change-log's types; a row that breaks a limit fails the write."""
        unknown = set(rows.columns) - {"key", "value", "vector", order_by} - {f.name for f in self.schema.fields}
        if unknown or "key" not in rows.columns:
            raise InvalidArgument(f"columns: {sorted(unknown) or 'no key'}")
        kinds = {f.name: f.dataType for f in self.schema.changelog().fields}
        columns = {}
        for name in ("key", "value", "vector", *(f.name for f in self.schema.fields)):
            if name not in rows.columns:
                columns[name] = F.lit(None).cast(kinds[name])
            elif name in ("key", "value") or rows.schema[name].dataType == kinds[name]:
                columns[name] = F.col(name).cast(kinds[name])
            elif name == "vector" and isinstance(rows.schema[name].dataType, T.ArrayType) or isinstance(rows.schema[name].dataType, T.NumericType):
                columns[name] = F.col(name).cast(kinds[name])
            else:
                raise InvalidArgument(f"{name} is {rows.schema[name].dataType.simpleString()}")
        columns["value"] = F.coalesce(columns["value"], F.lit(bytearray()))
        out = rows.select(*[c.alias(n) for n, c in columns.items()], (F.col(order_by) if order_by else F.monotonically_increasing_id()).alias("_order"))
        fine = F.octet_length("key").between(1, 1024) & (F.octet_length("value") <= 16 << 20) & (F.col("vector").isNull() | (F.size("vector") == self.dim) & ~F.exists("vector", lambda x: x.isNull()))
        wrong = F.raise_error(F.lit("a key, value or vector is outside its limits")).cast("binary")
        return out.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.col("key")).otherwise(wrong))

    def delete_many(self, keys: DataFrame) -> int:
        """Tombstones for the live ones among ``keys``; returns how many."""
        live = self.current().select("key")
        some = keys.select(F.col("key").cast("binary").alias("key")).distinct().join(live, "key", "left_semi")
        return self.put_many(some, op="DELETE")

    def replay(self, log: DataFrame) -> None:
        """Adds change rows that bring their own seq (op, key, value, vector, fields; each the whole new version). An older version than what is there is never seen,
        and replaying rows again changes nothing. From then on tombstones are kept, so that a late row doesn't bring a deleted key back."""
        self._check_open()
        self.flush()
        name = f"delta-{uuid.uuid4().hex}"
        kinds = {f.name: f.dataType for f in self.schema.changelog().fields}
        columns = {n: F.col(n).cast(t) if n in log.columns else F.lit(None).cast(t) for n, t in kinds.items()}
        # a vector's id is its version's number here
        columns["vector_id"] = F.when(columns["vector"].isNotNull(), F.coalesce(columns["vector_id"], columns["seq"]))
        log.select(*[c.alias(n) for n, c in columns.items()]).where("seq is not null and key is not null").write.parquet(f"{self.path}/{name}")
        n, seq, vid = self._read([name]).agg(F.count("*"), F.max("seq"), F.max("vector_id")).first()
        if n:
            m = self.manifest
            self._publish(replace(m, next_seq=max(m.next_seq, seq + 1), next_vector_id=max(m.next_vector_id, (vid or 0) + 1), deltas=(*m.deltas, name), delta_rows=m.delta_rows + n, tombstones=True))
            if self.manifest.delta_rows >= self.flush_threshold:
                self.compact()

    def _commit(self, rows: DataFrame, n: int, next_seq: int, next_vector_id: int) -> None:
        name = f"delta-{uuid.uuid4().hex}"
        rows.select(self.schema.changelog().names).write.parquet(f"{self.path}/{name}")
        m = self.manifest
        self._publish(replace(m, next_seq=next_seq, next_vector_id=next_vector_id, deltas=(*m.deltas, name), delta_rows=m.delta_rows + n))
        if self.manifest.delta_rows >= self.flush_threshold:
            self.compact()

    def _publish(self, manifest: Manifest) -> None:
        manifest = replace(manifest, number=self.manifest.number + 1)
        if any(n.endswith(".json") and int(n.removesuffix(".json")) >= self.next_seq for n in self.files.names("_log")):
            raise Corrupt("another writer has written records")
        self.files.create(f"_manifest/{manifest.number:08d}.json", manifest.to_json())
        self.manifest = manifest
        self.recent, self.newest, self.next_vector_id = [], {}, manifest.next_vector_id

    def compact(self) -> None:
        """A new base of the live records, by cell if there is an index; then the manifest moves on."""
        self._check_open()
        self.flush()
        old = self.manifest
        if not old.deltas and old.index == old.base_index:
            return
        name = f"base-{uuid.uuid4().hex}"
        log = self.changelog()
        rows = versions.latest(log) if old.tombstones else versions.current(log)
        if old.index:
            laid = self._index(old.index).assign(rows).repartitionByRange(F.col("cell"), F.col("key")).sortWithinPartitions("cell", "key")
            laid.write.partitionBy("cell").parquet(f"{self.path}/{name}")
        else:
            rows.repartitionByRange(F.col("key")).sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        self._publish(replace(old, base=name, deltas=(), delta_rows=0, base_index=old.index))
        self.vacuum()

    def vacuum(self, retained: int = RETAINED, grace_ms: int = GRACE_MS) -> list[str]:
        """Deletes manifests before the last ``retained``, and what no manifest that is left names once it is ``grace_ms`` old. Returns what went."""
        least = self.manifest.number - retained
        names = [n for n in self.files.names("_manifest") if n.endswith(".json")]
        gone = [f"_manifest/{n}" for n in names if int(n.removesuffix(".json")) < least]
        used = set()
        for n in names:
            if int(n.removesuffix(".json")) >= least:
                try:
                    m = Manifest.from_json(self.files.read(f"_manifest/{n}"))
                except Corrupt:
                    continue
                used |= {m.base, m.index, m.base_index, *m.deltas}
        before = time.time() * 1000 - grace_ms
        for n in self.files.names(""):
            if n.startswith(("base-", "delta-", "_staged-", "_index-")) and n not in used and self.files.modified(n) <= before:
                gone.append(n)
        for n in self.files.names("_log"):
            if not n.endswith(".json") or int(n.removesuffix(".json")) < self.manifest.next_seq:
                gone.append(f"_log/{n}")
        for n in gone:
            self.files.delete(n)
        return gone

    def _check_open(self) -> None:
        if not self.open_:
            raise StoreError("the table is closed")


def _row_to(row: dict) -> dict:
    return {n: {"b": base64.b64encode(x).decode()} if isinstance(x, bytes) else x for n, x in row.items()}


def _row_from(data: dict) -> dict:
    return {n: base64.b64decode(x["b"]) if isinstance(x, dict) else x for n, x in data.items()}
