"""BSON files as a Spark data source: ``spark.read.format("bson").load(folder)`` gives documents as JSON text.

Types that JSON lacks are written as extended JSON (``{"$oid": ...}``, ``{"$date": ...}`` and so on); with a schema,
documents come as typed rows instead. A file is a run of documents, cut into partitions of about PART bytes.
"""

from __future__ import annotations

import base64
import datetime
import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Largest document that is read.
MAX_DOCUMENT = 16 * 1024 * 1024
#: Bytes of a partition, or one longer document.
PART = 64 << 20


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(0, at)
    return data[at:end].decode(), end + 1


def _text(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<i", data, at)
    return data[at + 4 : at + 3 + n].decode("utf-8", "replace"), at + 4 + n


def _value(kind: int, data: bytes, at: int):
    if kind == 0x01:
        (v,) = struct.unpack_from("<d", data, at)
        return v if v == v and abs(v) != float("inf") else {"$numberDouble": "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"}, at + 8
    if kind in (0x02, 0x0D, 0x0E):
        text, end = _text(data, at)
        return (text if kind == 0x02 else {"$code" if kind == 0x0D else "$symbol": text}), end
    if kind in (0x03, 0x04):
        return _document(data, at, kind == 0x04)
    if kind == 0x05:
        (n,) = struct.unpack_from("<i", data, at)
        return {"$binary": {"base64": base64.b64encode(data[at + 5 : at + 5 + n]).decode(), "subType": f"{data[at + 4]:02x}"}}, at + 5 + n
    if kind == 0x07:
        return {"$oid": data[at : at + 12].hex()}, at + 12
    if kind == 0x08:
        return data[at] == 1, at + 1
    if kind == 0x09:
        (ms,) = struct.unpack_from("<q", data, at)
        try:
            when = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
            return {"$date": when.isoformat(timespec="milliseconds") + "Z"}, at + 8
        except OverflowError:
            return {"$date": {"$numberLong": str(ms)}}, at + 8
    if kind in (0x06, 0x0A):
        return None, at
    if kind == 0x0B:
        pattern, at = _cstring(data, at)
        options, at = _cstring(data, at)
        return {"$regularExpression": {"pattern": pattern, "options": options}}, at
    if kind == 0x10:
        return struct.unpack_from("<i", data, at)[0], at + 4
    if kind == 0x11:
        i, t = struct.unpack_from("<II", data, at)
        return {"$timestamp": {"t": t, "i": i}}, at + 8
    if kind == 0x12:
        return struct.unpack_from("<q", data, at)[0], at + 8
    if kind == 0x13:
        low, high = struct.unpack_from("<QQ", data, at)
        return {"$numberDecimal": _decimal(low, high)}, at + 16
    if kind in (0xFF, 0x7F):
        return {"$minKey" if kind == 0xFF else "$maxKey": 1}, at
    raise ValueError(f"BSON type 0x{kind:02x} is not supported")


def _decimal(low: int, high: int) -> str:
    sign = "-" if high >> 63 else ""
    if high >> 61 & 3 == 3:  # infinities, NaN, and the large form, which has no digits
        return "NaN" if high >> 58 & 31 == 31 else f"{sign}Infinity" if high >> 58 & 31 == 30 else f"{sign}0"
    exponent, digits = (high >> 49 & 0x3FFF) - 6176, (high & 0x1FFFFFFFFFFFF) << 64 | low
    return f"{sign}{digits}" if exponent == 0 else f"{sign}{digits}E{exponent:+d}"


def _document(data: bytes, at: int, array: bool = False):
    (n,) = struct.unpack_from("<i", data, at)
    end, at = at + n, at + 4
    out: dict = {}
    while data[at]:
        kind = data[at]
        name, at = _cstring(data, at + 1)
        out[name], at = _value(kind, data, at)
    if at + 1 != end:
        raise ValueError("a BSON document's length is wrong")
    return (list(out.values()) if array else out), end


def decode(data: bytes) -> dict:
    return _document(data, 0)[0]


def encode(document: dict) -> bytes:
    """Documents of plain values: text, numbers, booleans, null, times, bytes, lists and objects."""

    def element(name: str, v) -> bytes:
        key = name.encode() + b"\0"
        if v is None:
            return b"\x0a" + key
        if isinstance(v, bool):
            return b"\x08" + key + bytes([v])
        if isinstance(v, int):
            return b"\x10" + key + struct.pack("<i", v) if -(1 << 31) <= v < 1 << 31 else b"\x12" + key + struct.pack("<q", v)
        if isinstance(v, float):
            return b"\x01" + key + struct.pack("<d", v)
        if isinstance(v, str):
            raw = v.encode()
            return b"\x02" + key + struct.pack("<i", len(raw) + 1) + raw + b"\0"
        if isinstance(v, bytes):
            return b"\x05" + key + struct.pack("<i", len(v)) + b"\0" + v
        if isinstance(v, datetime.datetime):
            utc = v if v.tzinfo else v.replace(tzinfo=datetime.timezone.utc)
            return b"\x09" + key + struct.pack("<q", (utc - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(milliseconds=1))
        if isinstance(v, dict) and set(v) == {"$oid"}:
            return b"\x07" + key + bytes.fromhex(v["$oid"])
        if isinstance(v, (list, tuple)):
            return b"\x04" + key + encode({str(k): x for k, x in enumerate(v)})
        if isinstance(v, dict):
            return b"\x03" + key + encode(v)
        raise TypeError(f"can't write {type(v).__name__} as BSON")

    body = b"".join(element(k, v) for k, v in document.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def typed(value, t: T.DataType):
    """A decoded value as Spark's type; what doesn't fit is null, and a nested value in a text column is its JSON."""
    if value is None:
        return None
    if isinstance(value, dict) and len(value) == 1:
        (tag, inner), = value.items()
        if tag == "$date":
            when = datetime.datetime.fromisoformat(inner.replace("Z", "+00:00")) if isinstance(inner, str) else None
            return typed(when, t)
        if tag == "$oid":
            return inner if isinstance(t, T.StringType) else None
        if tag == "$binary" and isinstance(t, T.BinaryType):
            return base64.b64decode(inner["base64"])
    if isinstance(t, T.StructType):
        return tuple(typed(value.get(f.name), f.dataType) for f in t.fields) if isinstance(value, dict) else None
    if isinstance(t, T.ArrayType):
        return [typed(x, t.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(t, T.MapType):
        return {k: typed(x, t.valueType) for k, x in value.items()} if isinstance(value, dict) else None
    if isinstance(t, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    if isinstance(t, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(t, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(t, T.IntegerType) else 63
        return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and int(value) == value and -(1 << bits) <= value < 1 << bits else None
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(t, T.TimestampType):
        return value if isinstance(value, datetime.datetime) else None
    return None


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.kind = path.removeprefix("file://"), schema

    def partitions(self) -> list[InputPartition]:
        """Stretches of about PART bytes of each file, cut between documents by hopping over their lengths."""
        files = [self.path] if os.path.isfile(self.path) else [os.path.join(self.path, n) for n in sorted(os.listdir(self.path)) if n.endswith(".bson")]
        out = []
        for name in files:
            size, start, at = os.path.getsize(name), 0, 0
            with open(name, "rb") as f:
                while size - start > PART:
                    while at - start < PART and at < size:
                        f.seek(at)
                        at += _length(f.read(4))
                    out.append(InputPartition((name, start, at)))
                    start = at
            if size > start or not size:
                out.append(InputPartition((name, start, size)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, at, end = partition.value
        text = self.kind.fieldNames() == ["doc"] and isinstance(self.kind["doc"].dataType, T.StringType)
        with open(name, "rb") as f:
            f.seek(at)
            while at < end:
                head = f.read(4)
                n = _length(head)
                at += n
                document = decode(head + f.read(n - 4))
                yield (json.dumps(document, ensure_ascii=False),) if text else typed(document, self.kind)


def _length(head: bytes) -> int:
    n = struct.unpack("<i", head)[0] if len(head) == 4 else 0
    if not 5 <= n <= MAX_DOCUMENT:
        raise ValueError("a BSON document's length is wrong")
    return n


class BsonSource(DataSource):
    """``spark.read.format("bson")``: a file or folder that every executor sees; typed where a schema is given, else JSON text in ``doc``."""

    @classmethod
    def name(cls) -> str:
        return "bson"

    def schema(self) -> str:
        return "doc string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema)
