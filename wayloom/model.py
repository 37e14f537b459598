"""Schemas, change actions and the choice of the current row, shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
MEMBER = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("role", T.StringType()), T.StructField("type", T.StringType())]
)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)

NODES = T.StructType().add("id", T.LongType()).add("tags", TAGS).add("x", T.DoubleType()).add("y", T.DoubleType())
WAYS = T.StructType().add("id", T.LongType()).add("tags", TAGS).add("nodes", T.ArrayType(T.LongType()))
RELATIONS = T.StructType().add("id", T.LongType()).add("tags", TAGS).add("members", T.ArrayType(MEMBER))
CHANGES = T.StructType().add("id", T.LongType()).add("action", T.StringType())
LOCATIONS = T.StructType().add("id", T.LongType()).add("x", T.DoubleType()).add("y", T.DoubleType())
STATUS = T.StructType().add("part", T.StringType()).add("date", T.TimestampType()).add("sequence", T.IntegerType())

#: Actions: feeds say CREATE, derived tables say ADD; both say MODIFY and DELETE.
CREATE, ADD, MODIFY, DELETE = "C", "A", "M", "D"


@dataclass(frozen=True)
class Source:
    """A table with an ``id`` column and, where known, the changes of its last batch.

    rows, where given: data is the table before the batch without the ids in change, and these.
    """

    data: DataFrame
    change: DataFrame | None = None
    rows: DataFrame | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rank() -> Column:
    """Orders the rows of an id: by version, then by sequence; nulls come first."""
    low = F.lit(-(2**31))
    above = F.coalesce("sequence", low).cast("long") - low.cast("long")
    return F.coalesce("version", low).cast("long") * F.lit(2**32) + above


def current_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row of each id with the highest version (of those, with the highest sequence).

    For wide columns: the first-row filter over the window runs before the shuffle too, so an
    id with many rows sends one row per task. Rows with a null id are not rows of an object
    and are left out.
    """
    keep = list(dict.fromkeys(["id", *columns]))
    w = Window.partitionBy("id").orderBy(F.col("version").desc_nulls_last(), F.col("sequence").desc_nulls_last())
    return (
        df.where(F.col("id").isNotNull())
        .select(*keep, *(c for c in ("version", "sequence") if c not in keep))
        .withColumn("__n", F.row_number().over(w))
        .where("__n = 1")
        .select(*keep)
    )


def current_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As current_rows, for columns of fixed width: a hash aggregation with partial sums, without a sort."""
    return (
        df.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(*(F.max_by(c, _rank()).alias(c) for c in columns if c != "id"))
    )


def tag_key(tags: Column | str) -> Column:
    """Maps do not compare; their sorted entries do. Null and empty maps stay apart."""
    return F.array_sort(F.map_entries(tags))


def upper_type(member_type: Column) -> Column:
    return F.upper(member_type)
