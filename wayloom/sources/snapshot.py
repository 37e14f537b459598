"""Versioned tables in a folder: every batch writes new files, one small state file says which count."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.model import Source


class Files:
    """The few file operations on a folder, through the session's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """The text is written aside and renamed over the file."""
        fs, p = self.at(path)
        jvm = self.spark.sparkContext._jvm
        aside = jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, p, options)

    def remove(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


#: Batches whose rows are kept beside a table before it is written anew.
LAYERS = 8
#: Commits for which files that no longer count are kept, for readers that began before.
KEEP = 2


class SnapshotStore:
    """Tables in a folder. What state.json names counts, all else may be left over.

    A table is a full version (<table>/<version>/data) and up to LAYERS later ones that hold a batch's
    new rows and changed ids only (rows, change): a row counts if no later layer changed its id. So a
    batch writes what it changes, and a table without changes is not written at all.

    Versions written in a batch become visible together, with the statuses, when commit replaces
    state.json; until then readers see the old ones, and a failed batch leaves nothing behind that counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.state_file = f"{self.folder}/state.json"
        fresh = {"tables": {}, "status": {}, "next": 1, "stale": []}
        self.state = json.loads(self.files.read(self.state_file)) if self.files.exists(self.state_file) else fresh
        self.staged: dict[str, dict] = {}

    def stage(self, table: str, source: Source) -> Source:
        """Writes a new version and returns it as read from there."""
        version, old = self.state["next"], self.state["tables"].get(table)
        base = f"{self.folder}/{table}/{version}"
        if source.change is not None:
            source.change.write.mode("overwrite").parquet(f"{base}/change")
        if source.rows is not None and source.change is not None and old is not None and len(old["layers"]) < LAYERS:
            source.rows.write.mode("overwrite").parquet(f"{base}/rows")
            self.staged[table] = {"base": old["base"], "layers": [*old["layers"], version], "change": version}
        else:
            source.data.write.mode("overwrite").parquet(f"{base}/data")
            self.staged[table] = {"base": version, "layers": [], "change": None if source.change is None else version}
        return self._open(table, self.staged[table])

    def keep(self, table: str) -> Source:
        """The table as it is, with no changes."""
        self.staged[table] = self.state["tables"][table] | {"change": 0}
        return self._open(table, self.staged[table])

    def discard(self) -> None:
        """What was staged does not count; the next batch writes over it."""
        self.staged = {}

    def _part(self, table: str, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}/{version}/{name}")

    def _open(self, table: str, entry: dict) -> Source:
        data = self._part(table, entry["base"], "data")
        if entry["layers"]:
            layers = [(n, v) for n, v in enumerate(entry["layers"], 1)]
            rows = data.withColumn("__layer", F.lit(0))
            for n, v in layers:
                rows = rows.unionByName(self._part(table, v, "rows").withColumn("__layer", F.lit(n)))
            changed = reduce(DataFrame.unionByName, (self._part(table, v, "change").select("id", F.lit(n).alias("__last")) for n, v in layers))
            last = changed.groupBy("id").agg(F.max("__last").alias("__last"))
            data = rows.join(last, "id", "left").where("__last IS NULL OR __last = __layer").select(*data.columns)
        if entry["change"] == 0:
            return Source(data, self.spark.createDataFrame([], "id bigint, action string"))
        return Source(data, None if entry["change"] is None else self._part(table, entry["change"], "change"))

    def has(self, table: str) -> bool:
        return table in self.staged or table in self.state["tables"]

    def source(self, table: str) -> Source:
        return self._open(table, self.staged.get(table) or self.state["tables"][table])

    def committed(self, table: str) -> DataFrame:
        """The table as it was before this batch."""
        return self._open(table, self.state["tables"][table]).data

    def commit(self, status: dict | None = None) -> None:
        number = self.state["next"]
        tables = self.state["tables"] | self.staged
        used = lambda all_: {(t, v) for t, e in all_.items() for v in (e["base"], *e["layers"], e["change"]) if v}
        stale = [*self.state["stale"], *([t, v, number] for t, v in sorted(used(self.state["tables"]) - used(tables)))]
        old = [s for s in stale if s[2] <= number - KEEP]
        rest = [s for s in stale if s[2] > number - KEEP]
        new = {"tables": tables, "status": self.state["status"] if status is None else status, "next": number + 1, "stale": rest}
        self.files.replace(self.state_file, json.dumps(new))
        self.state, self.staged = new, {}
        for table, version, _ in old:
            self.files.remove(f"{self.folder}/{table}/{version}")


class StatusManager:
    """Date and sequence of the last successful run of each part."""

    def __init__(self, rows: dict | None = None):
        self.rows: dict[str, list] = dict(rows or {})

    def get_sequence(self, part: str = "base") -> int | None:
        return self.rows[part][1] if part in self.rows else None

    def get_date(self, part: str = "base") -> dt.datetime | None:
        date = self.rows[part][0] if part in self.rows else None
        return dt.datetime.fromisoformat(date) if date else None

    def get_min_sequence(self) -> int | None:
        return min((s for _, s in self.rows.values() if s is not None), default=None)

    def set_status(self, part: str, date: dt.datetime | None, sequence: int | None) -> None:
        self.rows[part] = [date.isoformat() if date else None, sequence]

    def set_status_from(self, part: str, src: str) -> None:
        """The status of part becomes that of src, which must have one."""
        self.rows[part] = list(self.rows[src])

    def remove_status(self, part: str) -> None:
        self.rows.pop(part, None)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, dt.datetime.fromisoformat(d) if d else None, s) for p, (d, s) in self.rows.items()]
        return spark.createDataFrame(rows, "part string, date timestamp, sequence int")


class NoStatus(StatusManager):
    """Keeps nothing: every update runs."""

    def get_sequence(self, part: str = "base") -> None:
        return None

    def get_date(self, part: str = "base") -> None:
        return None

    def get_min_sequence(self) -> None:
        return None

    def set_status(self, part: str, date, sequence) -> None:
        pass

    def set_status_from(self, part: str, src: str) -> None:
        pass
