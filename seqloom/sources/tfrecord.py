"""TFRecord files of examples, as a Python data source: ``spark.read.format("tfrecord")`` and ``df.write.format("tfrecord")``.

Reads gzip or plain files with int64, float and bytes features from any storage that Arrow can open; the schema says which features are wanted
and how. Writes one gzip file per partition. Written from the public file format: a record is an 8-byte length, a masked
CRC-32C of it, the data, and a masked CRC-32C of the data; the data is a protocol buffer of type Example.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, DoubleType, LongType, StringType, StructType


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _messages(data: bytes) -> Iterator[tuple[int, int, object]]:
    """``(field, wire type, value)`` of a protocol buffer."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, kind, value


def parse_example(data: bytes) -> dict[str, list]:
    """Feature names to lists of ints, floats or bytes."""
    out: dict[str, list] = {}
    for f, _, features in _messages(data):
        if f != 1:
            continue
        for g, _, entry in _messages(features):
            if g != 1:
                continue
            name, values = "", []
            for h, _, v in _messages(entry):
                if h == 1:
                    name = v.decode()
                elif h == 2:
                    values = _feature(v)
            out[name] = values
    return out


def _feature(data: bytes) -> list:
    for kind, _, body in _messages(data):
        out: list = []
        for f, wire, v in _messages(body):
            if f != 1:
                continue
            if kind == 1:
                out.append(v)
            elif kind == 2:
                out += struct.unpack(f"<{len(v) // 4}f", v)
            elif wire == 0:
                out.append(v - (1 << 64) if v >> 63 else v)
            else:
                at = 0
                while at < len(v):
                    x, at = varint(v, at)
                    out.append(x - (1 << 64) if x >> 63 else x)
        return out
    return []


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(data: bytes) -> tuple[bytes, bytes, bytes]:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)), data, struct.pack("<I", masked_crc(data))


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path.removeprefix("file:")))


def records(path: str, verify: bool = False) -> Iterator[bytes]:
    """The data of each record of a gzip or plain file. A file that is cut off raises; checksums are tested with ``verify``."""
    fs, at = open_path(path)
    with fs.open_input_stream(at, compression=None) as raw:
        zipped = raw.read(2) == b"\x1f\x8b"
    with fs.open_input_stream(at, compression="gzip" if zipped else None) as f:
        while head := f.read(12):
            if len(head) < 12:
                raise ValueError(f"{path}: cut off")
            n, crc = struct.unpack("<QI", head)
            data, tail = f.read(n), f.read(4)
            if len(data) < n or len(tail) < 4:
                raise ValueError(f"{path}: cut off")
            if verify and (masked_crc(head[:8]) != crc or struct.pack("<I", masked_crc(data)) != tail):
                raise ValueError(f"{path}: wrong checksum")
            yield data


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _part(k: int, data: bytes) -> bytes:
    return bytes([k << 3 | 2]) + _number(len(data)) + data


def example(row: dict[str, list]) -> bytes:
    """An Example of named lists of ints, floats or strings; features without values are left out."""
    entries = []
    for name, values in row.items():
        if not values:
            continue
        if isinstance(values[0], (str, bytes)):
            body = _part(1, b"".join(_part(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        elif isinstance(values[0], float):
            body = _part(2, _part(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            body = _part(3, _part(1, b"".join(_number(int(v)) for v in values)))
        entries.append(_part(1, _part(1, name.encode()) + _part(2, body)))
    return _part(1, b"".join(entries))


class TFRecordSource(DataSource):
    """Options: ``path`` (a file, a folder, or a pattern in the last part), ``verify`` (test checksums). The schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "user_id bigint, sequence_data array<bigint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TFRecordReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TFRecordWriter(schema, self.options["path"], overwrite)


class TFRecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.want, self.path, self.verify = schema, options["path"], options.get("verify", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, at = open_path(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.File:
            found = [at]
        else:
            folder, pattern = (at, "*") if info.type == pafs.FileType.Directory else at.rsplit("/", 1)
            listed = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            found = sorted(x.path for x in listed if x.type == pafs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith(("_", ".")))
        if not found:
            raise FileNotFoundError(f"no TFRecord files at {self.path}")
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        host = self.path.split("://", 1)[1].split("/", 1)[0] if scheme and not at.startswith(self.path.split("://", 1)[1].split("/", 1)[0] + "/") else ""
        return [InputPartition(f"{scheme}{host}{x}") for x in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for data in records(partition.value, self.verify):
            e = parse_example(data)
            yield tuple(_typed(e.get(f.name, []), f.dataType) for f in self.want.fields)


@dataclass
class Written(WriterCommitMessage):
    path: str


class TFRecordWriter(DataSourceWriter):
    """Each task writes its own file under a hidden name; the commit gives the finished ones their names, and removes what was there if it overwrites."""

    def __init__(self, schema: StructType, path: str, overwrite: bool):
        self.names, self.path, self.overwrite = [f.name for f in schema.fields], path, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, at = open_path(self.path)
        fs.create_dir(at, recursive=True)
        to = f"{at}/.{uuid.uuid4().hex}.tfrecord.gz"
        with fs.open_output_stream(to, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as f:
            for row in iterator:
                lists = {n: ([] if v is None else list(v) if isinstance(v, (list, tuple)) else [v]) for n, v in zip(self.names, row)}
                for part in framed(example(lists)):
                    f.write(part)
        return Written(to)

    def commit(self, messages: list) -> None:
        fs, at = open_path(self.path)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if x.type == pafs.FileType.File and not x.base_name.startswith("."):
                    fs.delete_file(x.path)
        tag = uuid.uuid4().hex[:8]
        for k, m in enumerate(m for m in messages if m):
            fs.move(m.path, f"{at}/data_{k:05d}_{tag}.tfrecord.gz")

    def abort(self, messages: list) -> None:
        fs, _ = open_path(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.path)


def _typed(values: list, kind: object) -> object:
    if isinstance(kind, ArrayType):
        return [_typed([v], kind.elementType) for v in values]
    if not values:
        return None
    v = values[0]
    if isinstance(kind, StringType):
        return v.decode("utf-8", "replace")
    if isinstance(kind, LongType):
        return int(v)
    if isinstance(kind, (FloatType, DoubleType)):
        return float(v)
    return v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecordSource)
