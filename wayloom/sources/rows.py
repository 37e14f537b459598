"""The row that every source of map objects gives."""

from __future__ import annotations

import pyarrow as pa

SCHEMA = (
    "kind string, id bigint, version int, visible boolean, date timestamp, changeset bigint, uid bigint, user string, "
    "tags map<string,string>, x double, y double, nodes array<bigint>, members array<struct<id:bigint,role:string,type:string>>"
)
ARROW = pa.schema(
    [
        ("kind", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("visible", pa.bool_()), ("date", pa.timestamp("us", "UTC")),
        ("changeset", pa.int64()), ("uid", pa.int64()), ("user", pa.string()), ("tags", pa.map_(pa.string(), pa.string())),
        ("x", pa.float64()), ("y", pa.float64()), ("nodes", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("id", pa.int64()), ("role", pa.string()), ("type", pa.string())]))),
    ]
)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)
