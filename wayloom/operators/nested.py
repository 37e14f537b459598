"""Deeply nested records as flat tables with parent-child links.

One pass over the payloads: a depth-first visitor with its own stack emits, for every object it
meets, the tag of its table, its key, its parent's key, its place in the parent and a payload.
The rows can be written partitioned by tag; a table is its partition with its schema applied.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATION, MEMBER, TAG = "relation", "member", "tag"
EMITTED = "record_id bigint, sequence int, tag string, key string, parent string, place int, payload string"
SCHEMAS = {
    RELATION: "id string, fields string",
    MEMBER: "type string, ref string, role string",
    TAG: "name string, value string",
}
_BATCH = 20_000
#: Characters up to which whole numbers are converted; the library refuses more than 4,300 digits.
_LONG = 4_000
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


@dataclass(frozen=True)
class Digits:
    """A whole number too long for the library to convert, as it stands in the payload."""

    text: str


def _whole(text: str) -> int | Digits:
    return int(text) if len(text) <= _LONG else Digits(text)


def _refuse(word: str) -> None:
    raise ValueError(word)


def _parse_deep(text: str):
    """JSON of any depth: an explicit stack where the library's parser recurses."""
    at, stack, value, have = 0, [], None, False

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        name, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        stack[-1][1] = name
        return skip(i + 1)

    at = skip(at)
    while True:
        if not have:
            c = text[at : at + 1]
            if c == "{" or c == "[":
                at = skip(at + 1)
                stack.append([{} if c == "{" else [], None])
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, have, at = stack.pop()[0], True, at + 1
                elif c == "{":
                    at = key(at)
                continue
            if c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            else:
                m = _ATOM.match(text, at)
                if not m:
                    raise ValueError(at)
                value, at = json.loads(m.group(), parse_int=_whole), m.end()
            have = True
        at = skip(at)
        if not stack:
            if at != len(text):
                raise ValueError(at)
            return value
        box, name = stack[-1]
        if isinstance(box, dict):
            box[name] = value
        else:
            box.append(value)
        c = text[at : at + 1]
        if c == ",":
            at, have = skip(at + 1), False
            if isinstance(box, dict):
                at = key(at)
        elif c == ("}" if isinstance(box, dict) else "]"):
            value, at = stack.pop()[0], at + 1
        else:
            raise ValueError(at)


def parse_record(payload: str | None) -> dict | None:
    """The object that a payload holds; None if it is not valid JSON or not an object."""
    if payload is None:
        return None
    try:
        record = json.loads(payload, parse_constant=_refuse, parse_int=_whole)
    except RecursionError:
        try:
            record = _parse_deep(payload)
        except ValueError:
            return None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def _written(value) -> str:
    """As json.dumps, for values of any depth and with Digits: an explicit stack of values and of texts that are ready."""
    out, stack = [], [(value, None)]
    while stack:
        value, ready = stack.pop()
        if ready is not None:
            out.append(ready)
        elif isinstance(value, Digits):
            out.append(value.text)
        elif isinstance(value, dict):
            parts = [(None, "{")]
            for n, (k, v) in enumerate(value.items()):
                parts += [(None, f"{', ' if n else ''}{json.dumps(k, ensure_ascii=False)}: "), (v, None)]
            stack.extend(reversed([*parts, (None, "}")]))
        elif isinstance(value, list):
            parts = [(None, "[")]
            for n, v in enumerate(value):
                parts += [(None, ", " if n else ""), (v, None)]
            stack.extend(reversed([*parts, (None, "]")]))
        else:
            out.append(json.dumps(value, ensure_ascii=False))
    return "".join(out)


def _plain(value) -> str | None:
    """A scalar as text; boxes as JSON; null stays null."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except (RecursionError, TypeError):
        return _written(value)


def _number(ref) -> str:
    """A reference as a number in text; empty if it is none."""
    if isinstance(ref, bool) or ref is None:
        return ""
    if isinstance(ref, str):
        ref = ref.strip()
        if not re.fullmatch(r"[+-]?[0-9]+", ref, re.ASCII):
            return ""
        sign, digits = ("-" if ref[0] == "-" else ""), ref.lstrip("+-").lstrip("0")
        return sign + digits if digits else "0"
    if isinstance(ref, float):
        return str(int(ref)) if ref.is_integer() else str(ref)
    if isinstance(ref, Digits):
        return ref.text
    return str(ref) if isinstance(ref, int) else ""


def _letter(kind) -> str:
    kind = kind.strip() if isinstance(kind, str) else ""
    return kind[:1].upper()


def _tags(tags) -> Iterator[tuple[str, object]]:
    """(name, value) of each tag: objects inside a value are flattened, names joined by colons."""
    if isinstance(tags, dict):
        stack = [(k, v) for k, v in reversed(tags.items())]
    elif isinstance(tags, list):
        stack = [(e["k"], e.get("v")) for e in reversed(tags) if isinstance(e, dict) and isinstance(e.get("k"), str)]
    else:
        return
    while stack:
        name, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{name}:{k}", v) for k, v in reversed(value.items()))
        else:
            yield name, value


def visit(record: dict) -> Iterator[tuple[str, str, str | None, int | None, dict]]:
    """(tag, key, parent, place, payload) of a record and all that it holds, depth first."""
    stack: list[tuple[dict, str, str | None, int | None]] = [(record, "", None, None)]
    while stack:
        node, path, parent, place = stack.pop()
        if parent is None:
            rest = {k: v for k, v in node.items() if k not in ("id", "tags", "members")}
            yield RELATION, path, parent, place, {"id": _number(node.get("id")), "fields": _plain(rest)}
        else:
            member = {"type": _letter(node.get("type")), "ref": _number(node.get("ref")), "role": _plain(node.get("role"))}
            yield MEMBER, path, parent, place, member
        for n, (name, value) in enumerate(_tags(node.get("tags"))):
            yield TAG, path, path, n, {"name": name, "value": _plain(value)}
        inner = node.get("members")
        inner = [inner] if isinstance(inner, dict) else inner if isinstance(inner, list) else []
        for n in range(len(inner) - 1, -1, -1):
            if isinstance(inner[n], dict):
                stack.append((inner[n], f"{path}.{n}" if parent is not None else str(n), path, n))


def emit_tagged(records: DataFrame) -> DataFrame:
    """Rows (record_id, sequence, tag, key, parent, place, payload) of all payloads of records
    (record_id, sequence, payload), in one pass and without a shuffle.

    Payloads that are null, empty, broken or no object give no rows; repeated records repeat their
    rows. Of repeated names in an object the last counts. An object where a list is expected stands
    for a list of one; nulls and scalars in a list of members keep their place and are no members;
    list entries of tags without a text ``k`` are no tags. A missing type or reference is empty.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for rid, seq, payload in zip(*(c.to_pylist() for c in b.columns)):
                record = parse_record(payload)
                if record is None:
                    continue
                for tag, key, parent, place, load in visit(record):
                    text = json.dumps(load, ensure_ascii=False).encode("utf-8", "replace").decode()
                    rows.append((rid, seq, tag, key, parent, place, text))
                    if len(rows) >= _BATCH:
                        yield flush(rows)
                        rows = []
        if rows:
            yield flush(rows)

    return records.select("record_id", F.col("sequence").cast("int").alias("sequence"), "payload").mapInArrow(run, EMITTED)


_ARROW = pa.schema(
    [("record_id", pa.int64()), ("sequence", pa.int32()), ("tag", pa.string()), ("key", pa.string()),
     ("parent", pa.string()), ("place", pa.int32()), ("payload", pa.string())]
)


def flat_table(emitted: DataFrame, tag: str) -> DataFrame:
    """One of the flat tables: record_id, sequence, key, parent, place and the columns of its schema."""
    return (
        emitted.where(F.col("tag") == tag)
        .withColumn("payload", F.from_json("payload", SCHEMAS[tag]))
        .select("record_id", "sequence", "key", "parent", "place", "payload.*")
    )


def write_tagged(emitted: DataFrame, folder: str) -> None:
    """All tables in one write, a directory for each tag."""
    emitted.write.mode("overwrite").partitionBy("tag").parquet(folder)


def read_tagged(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    return flat_table(spark.read.schema(EMITTED).parquet(folder), tag)


def named_parts(members: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct (record_id, path, kind, name) of the flat tables of members and tags."""
    members = members.select("record_id", F.col("key").alias("path"), F.lit(MEMBER).alias("kind"), F.concat("type", "ref").alias("name"))
    tags = tags.select("record_id", F.col("key").alias("path"), F.lit(TAG).alias("kind"), "name")
    return members.unionByName(tags).distinct()
