"""The registry of derived tables: built in order, updated batch by batch."""

from __future__ import annotations

import datetime as dt
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.model import DELETE, LOCATIONS, NODES, RELATIONS, WAYS, Source
from wayloom.operators.relational import apply_changes
from wayloom.sources.snapshot import NoStatus, SnapshotStore, StatusManager

BASE = {"node": NODES, "way": WAYS, "relation": RELATIONS}


class Tables:
    """Names to builders, in the order in which they were added; also as attributes."""

    def __init__(self) -> None:
        self._all: dict[str, Any] = {}

    def add(self, name: str, table: Any) -> None:
        self._all[name] = table

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_all"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Any:
        return self._all[name]

    def __contains__(self, name: str) -> bool:
        return name in self._all

    def __iter__(self) -> Iterator[Any]:
        return iter(self._all.values())

    def __len__(self) -> int:
        return len(self._all)

    def items(self):
        return self._all.items()


class Pipeline:
    """Base tables node, way and relation, and the tables derived from them, in a folder.

    A table is added with a function from the pipeline to its operator, which takes its inputs from
    ``source(name)``. Options: status (False: keep none), database (a name under which the tables are
    registered as views), locations (True: a fourth base table, location, has the place of every node,
    also of those that are no rows of node), and any others that the functions look up. Hooks of an
    operator: after_construct, before_update and after_update, called with the pipeline.

    Whatever fails leaves tables and statuses as they were, here as in the folder: it can be tried again
    with the same object.
    """

    def __init__(self, spark: SparkSession, folder: str, **options: Any):
        self.spark, self.options, self.info = spark, options, {}
        self.store = SnapshotStore(spark, folder)
        self.status: StatusManager = StatusManager(self.store.state["status"]) if self.get_option("status", True) else NoStatus()
        self.tables = Tables()

    def get_option(self, name: str, default: Any = None) -> Any:
        return self.options.get(name, default)

    def has_option(self, name: str) -> bool:
        return name in self.options

    def set_metadata(self, key: str, value: Any) -> None:
        self.info[key] = value

    def add_function(self, name: str, function: Callable) -> None:
        setattr(self, name, types.MethodType(function, self))

    def add_table(self, name: str, builder: Callable[[Pipeline], Any]) -> Callable[[Pipeline], Any]:
        self.tables.add(name, builder)
        return builder

    def source(self, name: str) -> Source:
        return self.store.source(name)

    @contextmanager
    def _whole(self) -> Iterator[None]:
        rows = dict(self.status.rows)
        try:
            yield
        except BaseException:
            self.status.rows = rows
            self.store.discard()
            raise

    def bases(self) -> dict:
        """The schemas of the base tables."""
        return BASE | ({"location": LOCATIONS} if self.get_option("locations", self.store.has("location")) else {})

    def load(self, base: dict[str, DataFrame], sequence: int | None = None, date: dt.datetime | None = None) -> None:
        """Puts in the base tables."""
        with self._whole():
            for name, schema in self.bases().items():
                data = base[name].select(*schema.fieldNames()) if name in base else self.spark.createDataFrame([], schema)
                empty = self.spark.createDataFrame([], "id bigint, action string")
                self.store.stage(name, Source(data, empty))
            self.status.set_status("base", date, sequence)
            self.store.commit(self.status.rows)

    def create(self) -> None:
        """Makes the database of the views, if one is named. Rights are the file system's matter."""
        if name := self.get_option("database"):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def exists(self) -> bool:
        """Whether the folder holds tables."""
        return self.store.files.exists(self.store.state_file)

    def drop(self) -> None:
        """Removes the folder with all tables, and the database of the views, if one is named."""
        if name := self.get_option("database"):
            self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
        self.store.files.remove(self.store.folder)
        self.store = SnapshotStore(self.spark, self.store.folder)
        self.status = StatusManager() if self.get_option("status", True) else NoStatus()

    def construct(self) -> None:
        """Builds every table from its inputs; all become visible together."""
        with self._whole():
            for name, builder in self.tables.items():
                operator = builder(self)
                self.store.stage(name, Source(operator.construct(), None))
                self._hook(operator, "after_construct")
                if self.status.get_sequence() is not None:
                    self.status.set_status_from(name, "base")
            self.store.commit(self.status.rows)

    def apply(self, batch: dict[str, DataFrame], sequence: int | None = None, date: dt.datetime | None = None) -> bool:
        """Puts a batch of changes (base name -> the table's columns and action, one row an id) into the base tables and updates.

        A batch that is not above the stored sequence has been applied before and is left alone.
        """
        known = self.status.get_sequence()
        if sequence is not None and known is not None and sequence <= known:
            return False
        with self._whole():
            for name in self.bases():
                data = self.store.committed(name)
                if (change := batch.get(name)) is None:
                    self.store.keep(name)
                else:
                    rows = change.where(F.col("action") != DELETE).select(*data.columns)
                    self.store.stage(name, Source(apply_changes(data, change), change.select("id", "action"), rows))
            self.status.set_status("base", date, sequence)
            self.update()
        return True

    def update(self) -> None:
        """Updates the tables whose sequence is behind the base's, in order, each from the changes of those before it."""
        with self._whole():
            base = self.status.get_sequence()
            for name, builder in self.tables.items():
                own = self.status.get_sequence(name)
                if base is not None and own is not None and own >= base:
                    continue
                operator = builder(self)
                self._hook(operator, "before_update")
                self.store.stage(name, operator.update(self.store.committed(name)))
                self._hook(operator, "after_update")
                if base is not None:
                    self.status.set_status_from(name, "base")
            self.store.commit(self.status.rows)

    def finalize(self, compact: bool = False) -> None:
        """Statistics of every table for the optimizer; compact: rewritten in files of the usual size first, as those with layers are anyway."""
        layered = [n for n in self.tables._all if self.store.state["tables"][n]["layers"]]
        with self._whole():
            for name in self.tables._all if compact else layered:
                source = self.store.source(name)
                self.store.stage(name, Source(source.data.repartition(source.data.columns[0]), source.change))
            if self.store.staged:
                self.store.commit(self.status.rows)
        prefix = f"{self.get_option('database') or self.spark.catalog.currentDatabase()}."
        for name in self.tables._all:
            at = f"{self.store.folder}/{name}/{self.store.state['tables'][name]['base']}/data"
            self.spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")
            self.spark.catalog.createTable(f"{prefix}{name}", at, source="parquet")
            self.spark.sql(f"ANALYZE TABLE {prefix}{name} COMPUTE STATISTICS")

    def views(self) -> None:
        """Every table as a temporary view of its name."""
        for name in [*self.bases(), *self.tables._all]:
            self.store.source(name).data.createOrReplaceTempView(name)

    def _hook(self, operator: Any, name: str) -> None:
        if callable(f := getattr(operator, name, None)):
            f(self)
