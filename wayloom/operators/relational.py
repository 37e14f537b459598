"""What the derived tables share: change sets, comparison of snapshots, application of changes.

A derived table is a pure function of its inputs. An update finds the ids that a batch may affect,
computes just those rows anew, and compares them with the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.model import ADD, DELETE, MODIFY, Source
from wayloom.session import cut


def comparable(df: DataFrame, name: str) -> Column:
    """A column as something that compares: a map by its sorted entries."""
    kind = df.schema[name].dataType
    return F.array_sort(F.map_entries(name)) if isinstance(kind, T.MapType) else F.col(name)


def selected(source: Source, *actions: str, other_than: str | None = None) -> DataFrame:
    """Distinct ids of the changes with one of the actions, or with any action but one; all ids where no changes are known."""
    if source.change is None:
        return source.data.select("id")
    keep = F.col("action") != other_than if other_than else F.col("action").isin(*actions)
    return source.change.where(keep).select("id").distinct()


def modified_or_deleted(source: Source) -> DataFrame:
    return selected(source, other_than=ADD)


def added_or_modified(source: Source) -> DataFrame:
    return selected(source, other_than=DELETE)


def modified(source: Source) -> DataFrame:
    return selected(source, MODIFY)


def deleted(source: Source) -> DataFrame:
    return selected(source, DELETE)


def changed(source: Source) -> DataFrame:
    """Ids of all changes."""
    return source.data.select("id") if source.change is None else source.change.select("id").distinct()


def last_actions(change: DataFrame, order: str) -> DataFrame:
    """One action an id: that of the row that comes last in order."""
    return change.groupBy("id").agg(F.max_by("action", order).alias("action"))


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not among ids."""
    return df.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def upsert(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows take the place of those with their key, or are added."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows.select(*df.columns))


def apply_changes(df: DataFrame, batch: DataFrame) -> DataFrame:
    """A base table after a batch (the table's columns and action, one row an id): deletions go, the rest is put in."""
    kept = df.join(batch.select("id"), "id", "left_anti")
    return kept.unionByName(batch.where(F.col("action") != DELETE).select(*df.columns))


def _compared(old: DataFrame, new: DataFrame, columns: Sequence[str] | None, key: str) -> DataFrame:
    """(key, action, row) of each key whose row was added, deleted or differs in one of columns; row is the new one."""
    columns = [c for c in (columns or new.columns) if c != key]
    mark = lambda df: F.struct(F.lit(1), *(comparable(df, c).alias(f"c{i}") for i, c in enumerate(columns)))
    was = old.select(key, mark(old).alias("was"))
    both = was.join(new.select(key, mark(new).alias("is"), F.struct(*new.columns).alias("row")), key, "full_outer")
    action = F.when(F.col("was").isNull(), ADD).when(F.col("is").isNull(), DELETE).when(~F.col("was").eqNullSafe(F.col("is")), MODIFY)
    return both.select(key, action.alias("action"), "row").where(F.col("action").isNotNull())


def difference(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, key: str = "id") -> DataFrame:
    """(key, action) of each key whose row was added, deleted or differs in one of columns.

    Nulls equal nulls, maps compare by their entries, lines by exact coordinates.
    """
    return _compared(old, new, columns, key).select(key, "action")


def refreshed(old: DataFrame, fresh: DataFrame, affected: DataFrame, columns: Sequence[str] | None = None) -> Source:
    """The table and its changes after the affected ids were computed anew; rows that stay the same are no changes.

    What has changed is written once, as table, changes and new rows all come from it.
    """
    before = old.join(affected.select("id").distinct(), "id", "left_semi")
    delta = cut(_compared(before, fresh, columns, "id"))
    put = delta.where(F.col("action") != DELETE).select("row.*").select(*old.columns)
    return Source(old.join(delta.select("id"), "id", "left_anti").unionByName(put), delta.select("id", "action"), put)


def holding(df: DataFrame, array: str, ids: DataFrame) -> DataFrame:
    """Ids of the rows whose array overlaps ids: an equi-join on the elements, not a test of every pair."""
    return df.select("id", F.explode(array).alias("element")).join(ids.select(F.col("id").alias("element")), "element", "left_semi").select("id").distinct()


def members(relations: DataFrame, kind: str) -> DataFrame:
    """(id, member, place): the members of one type, N, W or R in either case; members without an id are left out."""
    rows = relations.select("id", F.posexplode("members").alias("place", "m"))
    return rows.where((F.upper("m.type") == kind) & F.col("m.id").isNotNull()).select("id", F.col("m.id").alias("member"), "place")
