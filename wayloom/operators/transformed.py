"""Rows of a source turned into other rows, or dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.model import Source
from wayloom.operators.relational import changed, refreshed


@dataclass
class TransformedTable:
    """id and the given columns: expressions over the source's row, or a function over batches of rows.

    columns: name -> expression; keep: rows for which it is not true are dropped. Or: function, from a
    batch of the source's rows to a batch with id and the columns of schema; rows that it leaves out
    are dropped. Changes are A, M and D; a row whose values stay the same is none.
    """

    source: Source
    columns: Mapping[str, Column] | None = None
    keep: Column | None = None
    function: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    schema: str | None = None

    def _apply(self, df: DataFrame) -> DataFrame:
        if self.function is not None:
            def run(parts: Iterator[pd.DataFrame], f=self.function) -> Iterator[pd.DataFrame]:
                for part in parts:
                    yield f(part)

            return df.mapInPandas(run, f"id bigint, {self.schema}")
        rows = df if self.keep is None else df.where(F.coalesce(self.keep, F.lit(False)))
        return rows.select("id", *(c.alias(n) for n, c in self.columns.items() if n != "id"))

    def construct(self) -> DataFrame:
        return self._apply(self.source.data)

    def update(self, old: DataFrame) -> Source:
        affected = changed(self.source)
        if self.source.change is None:
            affected = affected.unionByName(old.select("id")).distinct()
        return refreshed(old, self._apply(self.source.data.join(affected, "id", "left_semi")), affected)
