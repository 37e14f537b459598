"""Rows of a source that satisfy a predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.model import DELETE, MODIFY, Source
from wayloom.operators.relational import changed, difference


@dataclass
class FilteredTable:
    """The source's schema, the rows for which predicate (a column or SQL text) is true; null is not.

    As a view the rows are never stored, and the changes are all of the source's: with their action
    if the id is in the view now, otherwise as deletions, also of ids that never were in it. As a
    table a deletion is only reported for a row that was there, everything else as modified.
    """

    source: Source
    predicate: Column | str
    view: bool = False

    def _holds(self) -> Column:
        p = F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate
        return F.coalesce(p, F.lit(False))

    def construct(self) -> DataFrame:
        return self.source.data.where(self._holds())

    def update(self, old: DataFrame | None = None) -> Source:
        if self.view:
            return Source(self.construct(), self._view_changes())
        if self.source.change is None:
            fresh = self.construct()
            return Source(fresh, difference(old, fresh))
        affected = changed(self.source)
        fresh = self.source.data.join(affected, "id", "left_semi").where(self._holds())
        gone = old.select("id").join(affected, "id", "left_semi").join(fresh.select("id"), "id", "left_anti")
        change = fresh.select("id", F.lit(MODIFY).alias("action")).unionByName(gone.select("id", F.lit(DELETE).alias("action")))
        fresh = fresh.select(*old.columns)
        return Source(old.join(affected, "id", "left_anti").unionByName(fresh), change, fresh)

    def _view_changes(self) -> DataFrame | None:
        if self.source.change is None:
            return None
        now = self.construct().select("id", F.lit(True).alias("there"))
        action = F.when(F.col("there"), F.col("action")).otherwise(DELETE)
        return self.source.change.select("id", "action").join(now, "id", "left").select("id", action.alias("action"))
