"""Attribute-value entries as wide, typed rows.

Entities are hash-bucketed by their key. Within a bucket, keys and values are dictionary-encoded,
so that each distinct (attribute, value) is parsed once; parsed values are scattered by row and column
index into one numpy array for each type, and the columns go out as Arrow record batches.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark and Arrow type of each kind of column.
KINDS = {
    "int": ("bigint", pa.int64()),
    "double": ("double", pa.float64()),
    "bool": ("boolean", pa.bool_()),
    "date": ("date", pa.date32()),
    "text": ("string", pa.string()),
}
_INT = re.compile(r"[+-]?[0-9]+", re.ASCII)
_DOUBLE = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?", re.ASCII)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", re.ASCII)
# Words read as true and as false
_TRUE = ("yes", "true", "1")
_FALSE = ("no", "false", "0")
#: Digits up to which whole numbers are converted; the library refuses more than 4,300.
_LONG = 4_000
_EPOCH = datetime.date(1970, 1, 1)


def read_value(kind: str, value: str):
    """The value as its kind reads it; None if it does not read. Integers have no bound here; those of more than _LONG digits are text without leading zeros."""
    if kind == "int":
        if not _INT.fullmatch(value):
            return None
        sign, digits = ("-" if value[0] == "-" else ""), value.lstrip("+-").lstrip("0")
        return sign + digits if len(digits) > _LONG else int(sign + (digits or "0"))
    if kind == "double":
        return float(value) if _DOUBLE.fullmatch(value) else None
    if kind == "bool":
        low = value.lower()
        return True if low in _TRUE else False if low in _FALSE else None
    if kind == "date":
        if not _DATE.fullmatch(value):
            return None
        try:
            return (datetime.date.fromisoformat(value) - _EPOCH).days
        except ValueError:
            return None
    return value


#: The array type of each kind; texts are scattered as numbers of the distinct texts.
ARRAYS = {"int": np.int64, "double": np.float64, "bool": np.bool_, "date": np.int32, "text": np.int64}


class Pool:
    """The distinct parsed values of one kind, by number and as an array."""

    def __init__(self, kind: str):
        self.kind, self.number, self.ready = kind, {}, 0
        self.stored, self.fits = np.zeros(1024, ARRAYS[kind]), np.zeros(1024, bool)

    def add(self, value) -> int:
        if (n := self.number.get(value)) is None:
            n = self.number[value] = len(self.number)
            if n >= len(self.stored):
                self.stored, self.fits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.stored, self.fits))
            self.fits[n] = self.kind != "int" or isinstance(value, int) and -(2**63) <= value < 2**63
            self.stored[n] = n if self.kind == "text" else value if self.fits[n] else 0
        return n


class Cells:
    """The entries of a batch as typed cells; parsed values are kept from batch to batch."""

    def __init__(self, types: Mapping[str, str]):
        self.names = list(types)
        self.index = {n: i for i, n in enumerate(self.names)}
        self.kinds = [types[n] for n in self.names]
        #: Place of a column in the array of its kind.
        self.slot = np.array([self.kinds[:i].count(k) for i, k in enumerate(self.kinds)] or [0])
        self.pools = {k: Pool(k) for k in self.kinds}
        self.known: dict[tuple[int, str], tuple[int, bool]] = {}

    def parsed(self, col: int, value: str) -> tuple[int, bool]:
        """(number of the parsed value among those of its kind, -1 if it does not read; whether it is an entry)."""
        if (out := self.known.get((col, value))) is None:
            text = value.strip(" ")
            got = read_value(self.kinds[col], text) if text else None
            if len(self.known) > 1_000_000:
                self.known.clear()
            out = self.known[col, value] = -1 if got is None else self.pools[self.kinds[col]].add(got), bool(text)
        return out

    def scatter(self, rows: np.ndarray, keys: pa.Array, items: pa.Array, n: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
        """Typed columns of n rows, and masks (column, row) of bad, conflicting and unfit cells, which are null."""
        k, v = pc.dictionary_encode(keys), pc.dictionary_encode(items)
        columns = np.array([self.index.get(x.strip(" ").lower(), -1) if x is not None else -1 for x in k.dictionary.to_pylist()] or [-1])
        col = columns[k.indices.fill_null(0).to_numpy(zero_copy_only=False)] if len(keys) else np.zeros(0, int)
        keep = (col >= 0) & (v.indices.is_valid().to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, bool))
        rows, col = rows[keep], col[keep].astype(np.int64)
        code = v.indices.fill_null(0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)
        texts = v.dictionary.to_pylist()
        pairs, back = np.unique(col * max(1, len(texts)) + code, return_inverse=True)
        looked = [self.parsed(int(p // max(1, len(texts))), texts[p % max(1, len(texts))]) for p in pairs.tolist()]
        number = np.array([x[0] for x in looked] or [0], np.int64)[back]
        entry = np.array([x[1] for x in looked] or [False])[back]
        bad, conflict, unfit = (np.zeros((len(self.names), n), bool) for _ in range(3))
        wrong = entry & (number < 0)
        bad[col[wrong], rows[wrong]] = True
        cell, number = (col * n + rows)[number >= 0], number[number >= 0]
        order = np.lexsort((number, cell))
        cell, number = cell[order], number[order]
        again = np.zeros(len(cell), bool)
        again[1:] = (cell[1:] == cell[:-1]) & (number[1:] != number[:-1])
        conflict.reshape(-1)[cell[again]] = True
        out: list[pa.Array | None] = [None] * len(self.names)
        for kind, pool in self.pools.items():
            mine = [c for c, x in enumerate(self.kinds) if x == kind]
            data, there = np.zeros((len(mine), n), ARRAYS[kind]), np.zeros((len(mine), n), bool)
            some = np.isin(cell // max(1, n), mine)
            c, r, x = cell[some] // n, cell[some] % n, number[some]
            data[self.slot[c], r], there[self.slot[c], r] = pool.stored[x], True
            unfit[c, r] = ~pool.fits[x]
            unfit[mine] &= ~(bad[mine] | conflict[mine])
            null = ~there | bad[mine] | conflict[mine] | unfit[mine]
            texts = pa.array(pool.number, pa.string()) if kind == "text" else None
            for i, c in enumerate(mine):
                array = pa.array(data[i], mask=null[i])
                out[c] = texts.take(array) if kind == "text" else array.cast(pa.date32()) if kind == "date" else array
        return out, bad, conflict, unfit

    def full(self) -> bool:
        """Whether so many values are known that it is better to begin anew."""
        return sum(len(p.number) for p in self.pools.values()) > 1_000_000


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row, key and value of each entry of the map, or list of key and value, in the batch's last column."""
    tags = b.column(b.num_columns - 1)
    offsets = tags.offsets.to_numpy(zero_copy_only=False)
    if isinstance(tags, pa.MapArray):
        keys, items = tags.keys, tags.items
    else:
        keys, items = (pc.struct_field(tags.values, k) for k in ("key", "value"))
    rows = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    first, many = int(offsets[0]), int(offsets[-1] - offsets[0])
    return rows, keys.slice(first, many), items.slice(first, many)


def _numbered(types: Mapping[str, str], taken: set[str]) -> list[str]:
    """Names of the wide columns: the attribute, with tag_ before it where that name is taken."""
    out: list[str] = []
    for n in types:
        name = n
        while name.lower() in taken:
            name = f"tag_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def widen(entities: DataFrame, key: list[str], tags: str, types: Mapping[str, str]) -> DataFrame:
    """One row per row of entities: its key columns, a typed column per attribute, and the arrays
    bad, conflict and unfit of attributes whose cell could not be filled cleanly and is null.

    Attribute names are trimmed (outer spaces) and in lower case before they are looked up in types
    (attribute -> int, double, bool, date or text); others are ignored. Null values, and values
    empty after trimming, are no entries. A cell is bad if one of its entries does not read, in
    conflict if its entries read as different values, unfit if a whole number exceeds 64 bits.
    A null or empty map gives a row of nulls. Names taken by key columns get the prefix tag_.
    """
    fields = entities.select(*key).schema.fields
    names = _numbered(types, {*(k.lower() for k in key), "bad", "conflict", "unfit"})
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
        + [f"`{n}` {KINDS[t][0]}" for n, t in zip(names, types.values())]
        + ["bad array<string>", "conflict array<string>", "unfit array<string>"]
    )
    types = dict(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(types)
        for b in batches:
            if not b.num_rows:
                continue
            columns, *masks = cells.scatter(*_flat(b), b.num_rows)
            lists = [_names(cells.names, m) for m in masks]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns, *lists], [*(f.name for f in fields), *names, "bad", "conflict", "unfit"])
            if cells.full():
                cells = Cells(types)

    return entities.select(*key, tags).mapInArrow(run, schema)


def _names(names: list[str], mask: np.ndarray) -> pa.Array:
    rows, cols = np.nonzero(mask.T)
    offsets = np.searchsorted(rows, np.arange(mask.shape[1] + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names or [""], pa.string()).take(pa.array(cols)))


def unclean_cells(wide: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, tag_key, state): the bad and conflict cells that the rows of widen report."""
    named = lambda state: F.transform(state, lambda k: F.struct(k.alias("tag_key"), F.lit(state).alias("state")))
    return wide.select(*key, F.inline(F.concat(named("bad"), named("conflict"))))


def widen_entries(rows: DataFrame, key: list[str], attribute: str, value: str, types: Mapping[str, str]) -> DataFrame:
    """As widen, for rows of entity, attribute and value, in any order and number."""
    return widen(gather_entries(rows, key, attribute, value, types), key, "entries", types)


def gather_entries(rows: DataFrame, key: list[str], attribute: str, value: str, types: Mapping[str, str]) -> DataFrame:
    """Entity-attribute-value rows as entities with a map, for widen.

    Per entity and attribute at most three entries remain, those that decide the cell: the least
    and greatest value read and one that does not read. They are found by a grouping with partial
    results, so an entity with any number of rows is small before it becomes a row. Rows with a
    null key column are kept as an entity of their own.
    """
    types = dict(types)
    fields = rows.select(*key).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "a string, lo string, read string, raw string, wrong string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple] = {}

        def look(a, v):
            if (out := seen.get((a, v))) is None:
                name, text = a.strip(" ").lower(), v.strip(" ")
                got = read_value(types[name], text) if name in types and text else None
                out = (None,) * 4 if name not in types or not text else (name, None, None, text) if got is None else (name, repr(got), text, None)
                if len(seen) > 500_000:
                    seen.clear()
                seen[a, v] = out
            return out

        for b in batches:
            if not b.num_rows:
                continue
            a, v = (b.column(b.num_columns - k).to_pylist() for k in (2, 1))
            out = [(None,) * 4 if x is None or y is None else look(x, y) for x, y in zip(a, v)]
            name, order, text, wrong = (pa.array([o[i] for o in out], pa.string()) for i in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], name, order, text, text, wrong], [*(f.name for f in fields), "a", "lo", "read", "raw", "wrong"])

    cells = (
        rows.select(*key, attribute, value)
        .mapInArrow(run, schema)
        .groupBy(*key, "a")
        .agg(F.min_by("read", "lo").alias("least"), F.max_by("read", "lo").alias("most"), F.min("wrong").alias("wrong"))
    )
    entries = F.filter(F.array(*(F.struct(F.col("a").alias("key"), F.col(c).alias("value")) for c in ("least", "most", "wrong"))), lambda e: e["value"].isNotNull())
    return cells.groupBy(*key).agg(F.flatten(F.collect_list(F.when(F.col("a").isNotNull(), entries))).alias("entries"))
