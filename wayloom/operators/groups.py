"""Groups of ways that hang together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.model import ADD, DELETE, MODIFY, Source
from wayloom.operators.forest import components
from wayloom.operators.relational import added_or_modified, changed, comparable, modified_or_deleted
from wayloom.session import cut


def property_key(df: DataFrame, columns: list[str]) -> Column:
    """One comparable value of the property columns; nulls equal nulls."""
    return F.struct(F.lit(0), *(comparable(df, c).alias(f"p{i}") for i, c in enumerate(columns)))


def star_links(ways: DataFrame, columns: list[str]) -> DataFrame:
    """Links (parent, child) between ways with equal properties that share a node.

    Each way at a node is linked to the least way there: k ways make k links, not k squared, and hang together all the same.
    """
    at = ways.select("id", property_key(ways, columns).alias("key"), F.explode(F.array_distinct("nodes")).alias("node")).where("node IS NOT NULL")
    first = at.groupBy("key", "node").agg(F.min("id").alias("parent"), F.max("id").alias("most")).where("parent != most")
    same = (F.col("a.node") == F.col("f.node")) & F.col("a.key").eqNullSafe(F.col("f.key"))
    return (
        at.alias("a").join(first.alias("f"), same).where("a.id != f.parent").select("f.parent", F.col("a.id").alias("child")).distinct()
    )


def grouped(ways: DataFrame, columns: list[str]) -> DataFrame:
    """(id, child): the members of each group of two and more; id is its least member."""
    comp = components(star_links(ways, columns))
    w = Window.partitionBy("component")
    return comp.groupBy("component").agg(F.min("vertex").alias("id")).join(comp.select("component", F.col("vertex").alias("child")), "component").select("id", "child")


@dataclass
class GroupedWayTable:
    """(id, child), child unique: ways that share a node with others of equal properties; ways on their own are in no group.

    After an update a group keeps the least id of the old groups that go on in it: those with a member
    in it that either lost no member to the batch or still hold the way with their id. Otherwise its
    id is its least member.
    """

    source: Source
    columns: list[str]

    def construct(self) -> DataFrame:
        return grouped(self.source.data, self.columns)

    def update(self, old: DataFrame) -> Source:
        ways, columns = self.source.data, self.columns
        moved, alive = modified_or_deleted(self.source), added_or_modified(self.source)
        hit = old.join(moved.withColumnRenamed("id", "child"), "child", "left_semi").select("id").distinct()
        touched = ways.join(changed(self.source), "id", "left_semi").select("id", property_key(ways, columns).alias("key"), F.explode("nodes").alias("node"))
        at = ways.select("id", property_key(ways, columns).alias("key"), F.explode("nodes").alias("node"))
        same = (F.col("a.node") == F.col("t.node")) & F.col("a.key").eqNullSafe(F.col("t.key"))
        beside = at.alias("a").join(touched.alias("t"), same, "left_semi").select("id")
        joined = old.join(beside.withColumnRenamed("id", "child"), "child", "left_semi").select("id")
        dirty = cut(hit.unionByName(joined).distinct())
        before = cut(old.join(dirty, "id", "left_semi"))
        scope = before.select(F.col("child").alias("id")).unionByName(beside).unionByName(alive).distinct()
        fresh = grouped(ways.join(scope, "id", "left_semi"), columns)
        kept = (
            before.join(fresh.withColumnRenamed("id", "least"), "child")
            .join(hit.withColumn("hit", F.lit(True)), "id", "left")
            .groupBy("id", "least")
            .agg(F.first("hit").alias("hit"), F.max((F.col("child") == F.col("id")).cast("int")).alias("holds"))
            .where("hit IS NULL OR holds = 1")
            .groupBy("least")
            .agg(F.min("id").alias("id"))
        )
        named = fresh.withColumnRenamed("id", "least").join(kept, "least", "left").select(F.coalesce("id", "least").alias("id"), "child")
        named = cut(named)
        a, b = (df.groupBy("id").agg(F.sort_array(F.collect_set("child")).alias("all")) for df in (before, named))
        change = (
            a.withColumnRenamed("all", "was").join(b.withColumnRenamed("all", "is"), "id", "full_outer")
            .withColumn("action", F.when(F.col("was").isNull(), ADD).when(F.col("is").isNull(), DELETE).when(F.col("was") != F.col("is"), MODIFY))
            .where("action IS NOT NULL").select("id", "action")
        )
        put = named.select("id", "child").join(change.where(F.col("action") != DELETE), "id", "left_semi")
        return Source(old.join(dirty, "id", "left_anti").unionByName(named.select("id", "child")), change, put)
