"""Map data in the binary block format. Blocks are found by their headers alone and decoded by as many tasks."""

from __future__ import annotations

import datetime as dt
import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayloom.sources.rows import SCHEMA, record_batch

KINDS = "NWR"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of the fields of a message: varints as numbers, all else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def packed(data: memoryview, signed: bool = False, running: bool = False) -> np.ndarray:
    """Packed varints; signed: zigzag; running: differences are added up."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    value = np.add.reduceat(parts, starts)
    out = ((value >> np.uint64(1)) ^ (np.uint64(0) - (value & np.uint64(1)))).astype(np.int64) if signed else value.astype(np.int64)
    return np.cumsum(out) if running else out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def inflate(blob: bytes) -> memoryview:
    """The contents of a blob: raw, or compressed with zlib, lzma or zstd (with the library for it)."""
    for number, value in fields(memoryview(blob)):
        if number == 1:
            return value
        if number == 3:
            return memoryview(zlib.decompress(value))
        if number == 4:
            return memoryview(lzma.decompress(value))
        if number == 7:
            import zstandard

            return memoryview(zstandard.ZstdDecompressor().decompressobj().decompress(bytes(value)))
        if number in (5, 6):
            raise ValueError("blob compression other than zlib, lzma and zstd")
    return memoryview(b"")


class Block:
    """The objects of one data block."""

    def __init__(self, data: memoryview):
        self.strings: list[str] = []
        self.grain, self.lat, self.lon, self.dates, self.groups = 100, 0, 0, 1000, []
        for number, value in fields(data):
            if number == 1:
                self.strings = [bytes(v).decode("utf-8", "replace") for n, v in fields(value) if n == 1]
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.grain = value
            elif number == 18:
                self.dates = value
            elif number == 19:
                self.lat = _signed(value)
            elif number == 20:
                self.lon = _signed(value)

    def _date(self, n: int | None) -> dt.datetime | None:
        return None if not n else dt.datetime.fromtimestamp(n * self.dates / 1000, dt.UTC)

    def _place(self, n: int, offset: int) -> float:
        return (offset + self.grain * n) / 1e9

    def _info(self, data: memoryview | None) -> tuple:
        got = dict(fields(data)) if data is not None else {}
        user = self.strings[got[5]] if got.get(5) else None
        return got.get(1), bool(got.get(6, 1)), self._date(got.get(2)), got.get(3), got.get(4), user

    def _tags(self, keys, values) -> list[tuple[str, str]]:
        return list({self.strings[k]: self.strings[v] for k, v in zip(keys, values)}.items())

    def rows(self) -> Iterator[tuple]:
        for group in self.groups:
            for number, value in fields(group):
                if number == 2:
                    yield from self._dense(value)
                elif number in (1, 3, 4):
                    yield self._single(number, value)

    def _single(self, number: int, data: memoryview) -> tuple:
        got: dict[int, int | memoryview] = dict(fields(data))
        keys, values = (packed(got.get(n, memoryview(b""))).tolist() for n in (2, 3))
        x = y = None
        nodes: list[int] = []
        members: list[dict] = []
        if number == 1:
            y, x = self._place(_zigzag(got[8]), self.lat), self._place(_zigzag(got[9]), self.lon)
            oid = _zigzag(got[1])
        else:
            oid = _signed(got[1])
        if number == 3:
            nodes = packed(got.get(8, memoryview(b"")), True, True).tolist()
        if number == 4:
            roles, kinds = (packed(got.get(n, memoryview(b""))).tolist() for n in (8, 10))
            refs = packed(got.get(9, memoryview(b"")), True, True).tolist()
            members = [{"id": r, "role": self.strings[s], "type": KINDS[k]} for r, s, k in zip(refs, roles, kinds)]
        version, visible, date, changeset, uid, user = self._info(got.get(4))
        return "N WR"[number - 1], oid, version, visible, date, changeset, uid, user, self._tags(keys, values), x, y, nodes, members

    def _dense(self, data: memoryview) -> Iterator[tuple]:
        got = dict(fields(data))
        empty = memoryview(b"")
        ids, lats, lons = (packed(got.get(n, empty), True, True).tolist() for n in (1, 8, 9))
        info = dict(fields(got[5])) if 5 in got else {}
        n = len(ids)
        column = lambda k, *how: packed(info[k], *how).tolist() if k in info else [None] * n
        versions, dates, sets, uids, users = column(1), column(2, True, True), column(3, True, True), column(4, True, True), column(5, True, True)
        visible = [bool(v) for v in packed(info[6]).tolist()] if 6 in info else [True] * n
        texts, at = packed(got.get(10, empty)).tolist(), 0
        for i in range(n):
            keys, values = [], []
            while at < len(texts) and texts[at]:
                keys.append(texts[at])
                values.append(texts[at + 1])
                at += 2
            at += 1
            user = self.strings[users[i]] if users[i] else None
            yield (
                "N", ids[i], versions[i], visible[i], self._date(dates[i]), sets[i], uids[i], user, self._tags(keys, values),
                self._place(lons[i], self.lon), self._place(lats[i], self.lat), [], [],
            )


def blobs(stream) -> Iterator[tuple[int, int]]:
    """(offset, size) of the data blobs of a file: only headers are read, blobs are skipped."""
    while head := stream.read(4):
        (size,) = struct.unpack(">I", head)
        got = dict(fields(memoryview(stream.read(size))))
        at = stream.tell()
        if bytes(got[1]) == b"OSMData":
            yield at, got[3]
        stream.seek(at + got[3])


def read(spark: SparkSession, paths: list[str], blobs_per_task: int = 16) -> DataFrame:
    """Objects of files, as of the line format. The driver reads the headers; the tasks read and decode the blobs."""
    from pyarrow import fs

    def find(path: str):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))

    places = []
    for path in paths:
        where, name = find(path)
        with where.open_input_file(name) as f:
            places += [(path, at, size) for at, size in blobs(f)]
    table = spark.createDataFrame(places, "path string, at bigint, size bigint").repartition(max(1, -(-len(places) // blobs_per_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for row in b.to_pylist():
                path = row["path"]
                where, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with where.open_input_file(name) as f:
                    data = f.read_at(row["size"], row["at"])
                yield record_batch(list(Block(inflate(data)).rows()))

    return table.mapInArrow(run, SCHEMA)
