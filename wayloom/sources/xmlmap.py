"""Map data in XML, full files and change files, plain or compressed with gzip or bzip2."""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayloom.sources.rows import ARROW, SCHEMA, record_batch

#: Objects of a batch that goes on to Spark.
BATCH = 10_000


def _open(stream, name: str):
    return gzip.open(stream) if name.endswith(".gz") else bz2.open(stream) if name.endswith(".bz2") else stream


def objects(stream) -> Iterator[tuple]:
    """Rows of a stream, as they come; the tree is cleared behind them, so a file of any size takes little memory.

    In a change file an object's block says whether it is deleted; elsewhere ``visible`` does.
    """
    block, root = None, None
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            root = e if root is None else root
            if e.tag in ("create", "modify", "delete"):
                block = e.tag
            continue
        if e.tag in ("create", "modify", "delete"):
            block = None
        if e.tag not in ("node", "way", "relation"):
            continue
        a = e.attrib
        whole = lambda k: int(a[k]) if a.get(k) else None
        real = lambda k: float(a[k]) if a.get(k) else None
        date = dt.datetime.fromisoformat(a["timestamp"].replace("Z", "+00:00")) if a.get("timestamp") else None
        tags = [(t.get("k"), t.get("v")) for t in e.iter("tag")]
        members = [{"id": int(m.get("ref")), "role": m.get("role") or "", "type": m.get("type", "")[:1].upper()} for m in e.iter("member")]
        visible = block != "delete" and a.get("visible", "true") != "false"
        yield (
            e.tag[0].upper(), int(a["id"]), whole("version"), visible, date, whole("changeset"), whole("uid"), a.get("user"),
            list(dict(tags).items()), real("lon"), real("lat"), [int(n.get("ref")) for n in e.iter("nd")], members,
        )
        e.clear()
        if root is not None and root is not e and block is None:
            root.clear()


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects of files, as of the line format. A file is one task's work: its format cannot be entered midway."""
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column("path").to_pylist():
                where, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with where.open_input_file(name) as f:
                    rows: list[tuple] = []
                    for row in objects(_open(io.BufferedReader(f), name)):
                        rows.append(row)
                        if len(rows) >= BATCH:
                            yield record_batch(rows)
                            rows = []
                    yield record_batch(rows)

    return names.mapInArrow(run, SCHEMA)


__all__ = ["ARROW", "objects", "read"]
