"""Parent, child and depth of relations within relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.model import Source
from wayloom.operators.relational import difference, members
from wayloom.session import cut

#: Depths that are computed: 1 is the relation itself, 2 a member, up to this one.
DEPTHS = 5


def descend(links: DataFrame, depths: int | None = DEPTHS) -> DataFrame:
    """(parent, child, depth): every pair at its least depth, from 2 on; None: to the end, however deep.

    A round joins the last level with the links and drops the pairs that are known, and pairs of a relation with itself.
    """
    level = cut(links.where("parent != child").select("parent", "child").distinct())
    known, depth = level.select("parent", "child", F.lit(2).alias("depth")), 2
    while (depths is None or depth < depths) and not level.isEmpty():
        step = level.withColumnRenamed("child", "middle").join(links.select(F.col("parent").alias("middle"), "child"), "middle")
        depth += 1
        level = step.where("parent != child").select("parent", "child").distinct().join(known, ["parent", "child"], "left_anti")
        if depths is None or depth < depths:
            level = cut(level)
        known = known.unionByName(level.select("parent", "child", F.lit(depth).alias("depth")))
    return known


@dataclass
class RelationHierarchy:
    """(parent, child, depth) of the relations of a source. self_ref adds each relation with itself at depth 1. An update builds anew."""

    source: Source
    self_ref: bool = False
    depths: int | None = DEPTHS

    def construct(self) -> DataFrame:
        out = descend(members(self.source.data, "R").select(F.col("id").alias("parent"), F.col("member").alias("child")), self.depths)
        if self.self_ref:
            own = self.source.data.select(F.col("id").alias("parent"), F.col("id").alias("child"), F.lit(1).alias("depth"))
            out = own.unionByName(out)
        return out

    def update(self, old: DataFrame) -> Source:
        fresh = cut(self.construct())
        pair = lambda df: df.withColumn("id", F.struct("parent", "child"))
        return Source(fresh, difference(pair(old), pair(fresh), ["depth"]).select("id.parent", "id.child", "action"))
