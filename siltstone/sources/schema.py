"""Record schemas: fixed at creation, one for all records of a table."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import Corrupt, InvalidArgument

MAX_FIELDS, MAX_NAME, MAX_DIM, MAX_KEY, MAX_VALUE = 32, 63, 4096, 1024, 16 << 20
#: Names that the filter language keeps for itself. Fixed values.
RESERVED = frozenset(("vector", "and", "or", "==", "!=", "<=", ">="))
#: Columns of every record, which fields can't be called.
RECORD = ("seq", "op", "key", "value", "vector_id", "vector")
FIELD_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType()}
VECTOR_TYPES = {"f32": T.FloatType(), "i8": T.ByteType()}
METRICS = ("l2", "dot")
INT64 = range(-(2**63), 2**63)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  #: int, float or string

    def check(self, value: object) -> object:
        """The value as stored; raises if it isn't one of this kind."""
        if self.kind == "int" and isinstance(value, int) and not isinstance(value, bool) and value in INT64:
            return value
        if self.kind == "float" and isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
        if self.kind == "string" and isinstance(value, str):
            return value
        raise InvalidArgument(f"{self.name} takes {self.kind}, not {value!r}")


@dataclass(frozen=True)
class Schema:
    dim: int
    fields: tuple[Field, ...] = ()
    vector_type: str = "f32"
    metric: str = "l2"

    def __post_init__(self) -> None:
        if not 1 <= self.dim <= MAX_DIM:
            raise InvalidArgument(f"dim {self.dim} is not in 1..{MAX_DIM}")
        if self.vector_type not in VECTOR_TYPES or self.metric not in METRICS:
            raise InvalidArgument(f"vector type {self.vector_type!r} or metric {self.metric!r}")
        if len(self.fields) > MAX_FIELDS:
            raise InvalidArgument(f"more than {MAX_FIELDS} fields")
        seen = set()
        for f in self.fields:
            if not re.fullmatch(r"[A-Za-z0-9_]+", f.name) or len(f.name) > MAX_NAME:
                raise InvalidArgument(f"field name {f.name!r}")
            if f.name.lower() in RESERVED or f.name.lower() in RECORD or f.name.lower() in seen:
                raise InvalidArgument(f"field name {f.name!r} is reserved or used twice")
            if f.kind not in FIELD_TYPES:
                raise InvalidArgument(f"field type {f.kind!r}")
            seen.add(f.name.lower())

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def element(self) -> T.DataType:
        return VECTOR_TYPES[self.vector_type]

    def field_columns(self) -> list[T.StructField]:
        return [T.StructField(f.name, FIELD_TYPES[f.kind]) for f in self.fields]

    def changelog(self) -> T.StructType:
        head = [("seq", T.LongType()), ("op", T.StringType()), ("key", T.BinaryType()), ("value", T.BinaryType()), ("vector_id", T.LongType()), ("vector", T.ArrayType(self.element))]
        return T.StructType([*(T.StructField(n, t) for n, t in head), *self.field_columns()])

    def check_vector(self, vector: object) -> list:
        values = list(vector)
        if len(values) != self.dim:
            raise InvalidArgument(f"a vector of {len(values)} components; the table's have {self.dim}")
        if self.vector_type == "i8":
            if any(int(v) != v or not -128 <= v <= 127 for v in values):
                raise InvalidArgument("int8 components are whole numbers in -128..127")
            return [int(v) for v in values]
        return [float(v) for v in values]

    def to_json(self) -> dict:
        return {"dim": self.dim, "vector_type": self.vector_type, "metric": self.metric, "fields": [[f.name, f.kind] for f in self.fields]}

    @staticmethod
    def from_json(data: dict | str) -> Schema:
        try:
            data = json.loads(data) if isinstance(data, str) else data
            return Schema(data["dim"], tuple(Field(*f) for f in data["fields"]), data["vector_type"], data["metric"])
        except (KeyError, TypeError, ValueError) as e:
            raise Corrupt(f"schema: {e}") from e


def to_key(key: bytes | str) -> bytes:
    raw = key.encode() if isinstance(key, str) else bytes(key)
    if not 1 <= len(raw) <= MAX_KEY:
        raise InvalidArgument(f"a key has 1 to {MAX_KEY} bytes")
    return raw


def to_value(value: bytes | str | None) -> bytes:
    raw = b"" if value is None else value.encode() if isinstance(value, str) else bytes(value)
    if len(raw) > MAX_VALUE:
        raise InvalidArgument(f"a value has at most {MAX_VALUE} bytes")
    return raw
