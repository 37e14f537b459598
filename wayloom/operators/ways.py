"""Ways as lines, and ways with the relations that they belong to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.geo import nudged, to_mercator
from wayloom.model import Source
from wayloom.operators.relational import changed, holding, members, refreshed
from wayloom.session import cut


def with_lines(ways: DataFrame, locations: DataFrame, mercator: bool = False) -> DataFrame:
    """The ways (with column nodes) and geom: the points of their nodes in order.

    One join on the node replaces a look-up for every way. Nodes without a row or a place are
    skipped; a point equal to the one before it is nudged. A way without points has an empty line.
    """
    refs = ways.select("id", F.posexplode("nodes").alias("place", "node")).where(F.col("node").isNotNull())
    places = locations.select(F.col("id").alias("node"), "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    points = (
        refs.join(places, "node")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("points"))
        .select("id", nudged(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("geom"))
    )
    if mercator:
        points = points.withColumn("geom", to_mercator(F.col("geom")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return ways.join(points, "id", "left").withColumn("geom", F.coalesce("geom", none))


def _moved(ways: DataFrame, nodes: Source) -> DataFrame:
    """Ways that hold a changed node, whatever the change."""
    return holding(ways, "nodes", changed(nodes))


@dataclass
class PlainWayTable:
    """id, nodes, the columns (name -> expression over the way) and geom; ways with fewer than two points are dropped.

    Affected by a batch: changed ways and ways with a changed node.
    """

    ways: Source
    nodes: Source
    columns: Mapping[str, Column] = field(default_factory=dict)
    keep: Column | None = None
    mercator: bool = False

    def _build(self, ways: DataFrame) -> DataFrame:
        if self.keep is not None:
            ways = ways.where(F.coalesce(self.keep, F.lit(False)))
        ways = ways.select("id", "nodes", *(c.alias(n) for n, c in self.columns.items()))
        return with_lines(ways, self.nodes.data, self.mercator).where(F.size("geom") > 1)

    def construct(self) -> DataFrame:
        return self._build(self.ways.data)

    def update(self, old: DataFrame) -> Source:
        affected = cut(changed(self.ways).unionByName(_moved(self.ways.data, self.nodes)).distinct())
        return refreshed(old, self._build(self.ways.data.join(affected, "id", "left_semi")), affected)


@dataclass
class RelationWayTable:
    """Each way that is a member of a relation and is there: id, nodes, rels (sorted ids of its relations, each once),
    the columns, and geom if nodes are given; then ways with fewer than two points are dropped.

    Affected by a batch: changed ways, ways with a changed node (with geometry), members of changed
    relations, and ways that were members of them.
    """

    ways: Source
    relations: Source
    nodes: Source | None = None
    columns: Mapping[str, Column] = field(default_factory=dict)
    keep: Column | None = None

    def _build(self, ways: DataFrame, links: DataFrame) -> DataFrame:
        rels = links.groupBy(F.col("member").alias("id")).agg(F.sort_array(F.collect_set("rel")).alias("rels"))
        if self.keep is not None:
            ways = ways.where(F.coalesce(self.keep, F.lit(False)))
        out = ways.select("id", "nodes", *(c.alias(n) for n, c in self.columns.items())).join(rels, "id")
        return out if self.nodes is None else with_lines(out, self.nodes.data).where(F.size("geom") > 1)

    def _links(self) -> DataFrame:
        return members(self.relations.data, "W").select(F.col("id").alias("rel"), "member").distinct()

    def construct(self) -> DataFrame:
        return self._build(self.ways.data, self._links())

    def update(self, old: DataFrame) -> Source:
        links, rels = self._links(), changed(self.relations)
        now = links.join(rels.withColumnRenamed("id", "rel"), "rel", "left_semi").select(F.col("member").alias("id"))
        affected = changed(self.ways).unionByName(now).unionByName(holding(old, "rels", rels))
        if self.nodes is not None:
            affected = affected.unionByName(_moved(self.ways.data, self.nodes))
        affected = cut(affected.distinct())
        ways = self.ways.data.join(affected, "id", "left_semi")
        return refreshed(old, self._build(ways, links.join(affected.withColumnRenamed("id", "member"), "member", "left_semi")), affected)
