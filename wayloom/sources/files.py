"""Map data files by their names, and diffs in a folder."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.sources import opl, pbf, xmlmap
from wayloom.sources.snapshot import Files

LISTED = "path string, modificationTime timestamp, length bigint, content binary"
_DATA = r"\.(opl|osc|osm|xml)(\.gz|\.bz2)?$"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a file: .pbf, .opl, XML as .osm, .osc or .xml; the last four also with .gz, and .bz2."""
    if path.endswith(".pbf"):
        return pbf.read(spark, [path])
    if re.search(r"\.(osm|osc|xml)(\.gz|\.bz2)?$", path):
        return xmlmap.read(spark, [path])
    return opl.read(spark, path)


def sequence_of(path: Column) -> Column:
    """The sequence of a diff: nested as 004/600/123 it is one number, else the last number in the file's name."""
    nested = F.regexp_extract(path, r"(?:^|/)(\d{3})/(\d{3})/(\d{3})\.[^/]*$", 0)
    digits = F.regexp_replace(F.substring_index(nested, ".", 1), r"\D", "")
    flat = F.regexp_extract(F.regexp_extract(path, r"([^/.]*)[^/]*$", 1), r"(\d+)\D*$", 1)
    return F.nullif(F.when(nested != "", digits).otherwise(flat), F.lit("")).try_cast("int")


def diffs(files: DataFrame) -> DataFrame:
    """(sequence, path, size) of the diffs among listed files (path, length); states and other files are none."""
    rows = files.where(F.col("path").rlike(_DATA)).select(sequence_of(F.col("path")).alias("sequence"), "path", F.col("length").alias("size"))
    return rows.where("sequence IS NOT NULL")


def list_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """The diffs of a folder at any depth. Files are listed, not opened."""
    return diffs(spark.read.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").load(folder))


def state_date(spark: SparkSession, path: str) -> dt.datetime | None:
    """The timestamp in the state file beside a diff (``123.state.txt``), None where there is none."""
    files, state = Files(spark), re.sub(r"\.[^/]*$", ".state.txt", path)
    if not files.exists(state):
        return None
    found = re.search(r"^timestamp=(.*)$", files.read(state), re.M)
    return dt.datetime.fromisoformat(found.group(1).strip().replace("\\", "").replace("Z", "+00:00")) if found else None
