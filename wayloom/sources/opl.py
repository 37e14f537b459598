"""One object a line: the text format of map data, read and written with expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.model import CREATE, DELETE, MODIFY


def unescaped(text: Column) -> Column:
    """``%hex%`` stands for the character with that number."""
    char = lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")
    parts = F.transform(F.split(text, "%"), lambda x, i: F.when(i % 2 == 1, char(x)).otherwise(x))
    return F.when(text.contains("%"), F.array_join(parts, "")).otherwise(text)


def escaped(text: Column) -> Column:
    """Characters that mean something in the format become ``%hex%``."""
    for c in "% ,=@\n\r\t":
        text = F.replace(text, F.lit(c), F.lit("\0" if c == "%" else f"%{ord(c):02x}%"))
    return F.replace(text, F.lit("\0"), F.lit("%25%"))


def _field(letter: str) -> Column:
    """The field that begins with a letter, null if the line has none."""
    hit = F.filter("fields", lambda f, i: (i > 0) & (F.substr(f, F.lit(1), F.lit(1)) == letter))
    return F.substr(F.get(hit, 0), F.lit(2))


def _list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def parse(lines: DataFrame) -> DataFrame:
    """Objects of a column ``value`` of lines: (kind N, W or R, id, version, visible, date, changeset, uid, user, tags, x, y, nodes, members).

    Empty lines and lines of other kinds have no row. A repeated key keeps its last value.
    """
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("fields")).where(F.substr(F.get("fields", 0), F.lit(1), F.lit(1)).isin("n", "w", "r"))
    head = F.get("fields", 0)
    pair = lambda e: F.struct(unescaped(F.substring_index(e, "=", 1)).alias("key"), unescaped(F.substr(e, F.locate("=", e) + 1)).alias("value"))
    entries = F.transform(_list(_field("T")), pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    member = lambda m: F.struct(
        F.substring_index(F.substr(m, F.lit(2)), "@", 1).cast("long").alias("id"),
        unescaped(F.when(F.locate("@", m) > 0, F.substr(m, F.locate("@", m) + 1)).otherwise("")).alias("role"),
        F.upper(F.substr(m, F.lit(1), F.lit(1))).alias("type"),
    )
    node = lambda n: F.regexp_replace(n, r"^n|x.*$", "").cast("long")
    return f.select(
        F.upper(F.substr(head, F.lit(1), F.lit(1))).alias("kind"), F.substr(head, F.lit(2)).cast("long").alias("id"),
        _field("v").cast("int").alias("version"), (F.coalesce(_field("d"), F.lit("V")) != "D").alias("visible"),
        F.try_to_timestamp(_field("t")).alias("date"), _field("c").cast("long").alias("changeset"), _field("i").cast("long").alias("uid"),
        unescaped(_field("u")).alias("user"), F.map_from_entries(last).alias("tags"),
        F.nullif(_field("x"), F.lit("")).cast("double").alias("x"), F.nullif(_field("y"), F.lit("")).cast("double").alias("y"),
        F.transform(_list(_field("N")), node).alias("nodes"), F.transform(_list(_field("M")), member).alias("members"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def action() -> Column:
    """What an object with visible and version says: C for a visible first version, M for another or none, D if not visible."""
    return F.when(~F.col("visible"), DELETE).when(F.col("version") == 1, CREATE).otherwise(MODIFY)


def base_tables(objects: DataFrame, keep_empty_nodes: bool = True) -> dict[str, DataFrame]:
    """The base tables of a full file. Without keep_empty_nodes only nodes with tags are rows; their places belong into locations."""
    there = objects.where("visible")
    nodes = there.where("kind = 'N'").select("id", "tags", "x", "y")
    return {
        "node": nodes if keep_empty_nodes else nodes.where(F.size("tags") > 0),
        "way": there.where("kind = 'W'").select("id", "tags", "nodes"),
        "relation": there.where("kind = 'R'").select("id", "tags", "members"),
    }


def locations(objects: DataFrame) -> DataFrame:
    """(id, x, y) of all nodes with a place, with or without tags."""
    return objects.where("kind = 'N' AND visible AND x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y")


def batches(objects: DataFrame, keep_empty_nodes: bool = True) -> dict[str, DataFrame]:
    """The batch of a change file by base table: the object's columns and action; of several versions of an id the last.

    Without keep_empty_nodes a node without tags is a deletion. location has the places of all nodes; one without a place is a deletion.
    """
    last = (
        objects.withColumn("action", action())
        .groupBy("kind", "id")
        .agg(F.max_by(F.struct("action", "tags", "x", "y", "nodes", "members"), F.coalesce("version", F.lit(0))).alias("o"))
        .select("kind", "id", "o.*")
    )
    gone = F.col("action") if keep_empty_nodes else F.when(F.size("tags") == 0, DELETE).otherwise(F.col("action"))
    placed = F.when(F.col("x").isNull() | F.col("y").isNull(), DELETE).otherwise(F.col("action"))
    return {
        "location": last.where("kind = 'N'").select("id", "x", "y", placed.alias("action")),
        "node": last.where("kind = 'N'").select("id", "tags", "x", "y", gone.alias("action")),
        "way": last.where("kind = 'W'").select("id", "tags", "nodes", "action"),
        "relation": last.where("kind = 'R'").select("id", "tags", "members", "action"),
    }


def render(objects: DataFrame) -> DataFrame:
    """Lines (value) of objects as of parse; what is null is left out."""
    field = lambda letter, c: F.when(c.isNotNull(), F.concat(F.lit(letter), c))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(F.coalesce(e["value"], F.lit(""))))), ",")
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("n"), n.cast("string"))), ",")
    members = F.array_join(F.transform("members", lambda m: F.concat(F.lower(m["type"]), m["id"].cast("string"), F.lit("@"), escaped(F.coalesce(m["role"], F.lit(""))))), ",")
    only = lambda kind, c: F.when(F.col("kind") == kind, c)
    return objects.select(
        F.concat_ws(
            " ", F.concat(F.lower("kind"), F.col("id").cast("string")), field("v", F.col("version").cast("string")),
            F.when(F.col("visible"), "dV").otherwise("dD"), field("t", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            field("i", F.col("uid").cast("string")), F.concat(F.lit("T"), F.coalesce(tags, F.lit(""))),
            only("N", field("x", F.col("x").cast("string"))), only("N", field("y", F.col("y").cast("string"))),
            only("W", F.concat(F.lit("N"), nodes)), only("R", F.concat(F.lit("M"), members)),
        ).alias("value")
    )
