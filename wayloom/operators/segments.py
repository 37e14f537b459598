"""Ways cut at intersections, and pieces with equal properties joined to the longest lines without a fork."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.model import ADD, DELETE, Source
from wayloom.operators.forest import components
from wayloom.operators.groups import property_key
from wayloom.operators.relational import added_or_modified, changed, holding
from wayloom.operators.ways import with_lines
from wayloom.session import cut

#: A piece's number is its way's id times this, plus its place in the way. Ids go up to 2**43.
PIECES = 1 << 20


def _clean(ways: DataFrame) -> DataFrame:
    """Null nodes go, and ways with fewer than two nodes."""
    return ways.withColumn("nodes", F.array_compact("nodes")).where(F.size("nodes") > 1)


def intersections(ways: DataFrame) -> DataFrame:
    """(node): an occurrence at an end of a way weighs 1, within it 2; more than 2 in all is an intersection, whatever the properties."""
    refs = ways.select(F.size("nodes").alias("n"), F.posexplode("nodes").alias("place", "node"))
    weight = F.when((F.col("place") == 0) | (F.col("place") == F.col("n") - 1), 1).otherwise(2)
    return refs.groupBy("node").agg(F.sum(weight).alias("weight")).where("weight > 2").select("node")


def cut_pieces(ways: DataFrame, crossings: DataFrame, columns: list[str]) -> DataFrame:
    """(piece, way, key, nodes): the ways cut at interior intersections; both sides keep the node."""
    inner = ways.select("id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("place", "node")).where("place > 0 AND place < n - 1")
    cuts = inner.join(crossings, "node", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("cuts"))
    ends = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("nodes") - 1))
    part = lambda i: F.slice("nodes", F.get("ends", i) + 1, F.get("ends", i + 1) - F.get("ends", i) + 1)
    fits = (F.abs("id") < 1 << 43) & (F.col("place") < PIECES)
    number = F.when(fits, F.col("id") * PIECES + F.col("place")).otherwise(F.raise_error(F.lit("way id beyond 2**43, or a way of more than 2**20 pieces")))
    return (
        ways.join(cuts, "id", "left")
        .withColumn("ends", ends)
        .select("id", property_key(ways, columns).alias("key"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ends") - 2), part)).alias("place", "nodes"))
        .select(number.alias("piece"), F.col("id").alias("way"), "key", "nodes")
    )


def _first(nodes: Column) -> Column:
    return F.element_at(nodes, 1)


def _last(nodes: Column) -> Column:
    return F.element_at(nodes, -1)


def fuse_points(pieces: DataFrame, crossings: DataFrame) -> DataFrame:
    """(key, node, parent, child): nodes, no intersections, at which exactly two ends of different pieces with equal properties meet."""
    ends = pieces.select("piece", "key", F.explode(F.array(_first(F.col("nodes")), _last(F.col("nodes")))).alias("node"))
    met = ends.join(crossings, "node", "left_anti").groupBy("key", "node").agg(
        F.count(F.lit(1)).alias("n"), F.min("piece").alias("parent"), F.max("piece").alias("child")
    )
    return met.where("n = 2 AND parent != child").drop("n")


def chain(pieces: list[tuple[list[int], list[int]]]) -> list[int]:
    """The line of pieces (nodes, those of its end nodes at which it is fused), which hang together without a fork.

    Open lines run from the end with the lower node; closed ones, fused all round, begin at their
    least node and run towards the lower of its neighbours.
    """
    at: dict[int, list[int]] = {}
    for i, (_, fused) in enumerate(pieces):
        for v in fused:
            at.setdefault(v, []).append(i)
    loose = [i for i, (_, fused) in enumerate(pieces) if len(fused) < 2]
    i = loose[0] if loose else 0
    nodes, fused = pieces[i]
    line = list(nodes) if not fused or nodes[-1] in fused[-1:] else list(reversed(nodes))
    used = {i}
    while len(used) < len(pieces):
        i = next(k for k in at[line[-1]] if k not in used)
        used.add(i)
        more = pieces[i][0]
        line += more[1:] if more[0] == line[-1] else more[-2::-1]
    if loose:
        back = line[::-1]
        return min(line, back) if line[0] == line[-1] else line if line[0] < line[-1] else back
    ring = line[:-1]
    k = ring.index(min(ring))
    ring = ring[k:] + ring[:k]
    if ring[1] > ring[-1]:
        ring = ring[:1] + ring[:0:-1]
    return ring + ring[:1]


def _chains(pieces: DataFrame) -> DataFrame:
    """(way, nodes, ways) of each component; the component is the unit of work, not the property group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def line(g: pd.DataFrame) -> tuple[int, list[int], list[int]]:
            rows = [([int(v) for v in n], [int(v) for v in f]) for n, f in zip(g["nodes"], g["fused"])]
            return int(g["way"].min()), chain(rows), sorted({int(w) for w in g["way"]})

        def out(lines: list) -> pd.DataFrame:
            return pd.DataFrame(lines, columns=["way", "nodes", "ways"])

        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            ids = part["component"].to_numpy()
            borders = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if len(borders):
                yield out([line(part.iloc[a:b]) for a, b in zip(np.r_[0, borders[:-1]], borders)])
            held = part.iloc[borders[-1] if len(borders) else 0 :]
        if held is not None and len(held):
            yield out([line(held)])

    bucketed = pieces.repartition("component").sortWithinPartitions("component", "piece")
    return bucketed.select("component", "way", "nodes", "fused").mapInPandas(run, "way bigint, nodes array<bigint>, ways array<bigint>")


def segments(ways: DataFrame, columns: list[str], locations: DataFrame | None, around: DataFrame | None = None) -> DataFrame:
    """(id, columns, nodes, ways[, geom]) of the ways; around: the ways that decide what is an intersection, if they are more.

    Ids are hashes of the content: equal segments have equal ids in any run.
    """
    ways = _clean(ways)
    crossings = cut(intersections(ways if around is None else _clean(around)))
    pieces = cut(cut_pieces(ways, crossings, columns))
    points = cut(fuse_points(pieces, crossings))
    comp = components(points.select("parent", "child")).select(F.col("vertex").alias("piece"), "component")
    joints = points.select(F.explode(F.array("parent", "child")).alias("piece"), "node").groupBy("piece").agg(F.collect_list("node").alias("joints"))
    fused = pieces.join(comp, "piece").join(joints, "piece").withColumn(
        "fused", F.filter(F.array(_first(F.col("nodes")), _last(F.col("nodes"))), lambda v: F.array_contains("joints", v))
    )
    turned = F.reverse("nodes")
    straight = F.when(_first(F.col("nodes")) == _last(F.col("nodes")), F.least(F.col("nodes"), turned)).when(
        _first(F.col("nodes")) < _last(F.col("nodes")), F.col("nodes")
    ).otherwise(turned)
    single = pieces.join(comp, "piece", "left_anti").select("way", straight.alias("nodes"), F.array("way").alias("ways"))
    lines = _chains(fused).unionByName(single)
    out = lines.join(ways.select(F.col("id").alias("way"), *columns), "way").drop("way")
    content = [property_key(out, columns), F.col("ways"), F.col("nodes")]
    if locations is None:
        return out.select(F.xxhash64(*content).alias("id"), *columns, "nodes", "ways")
    out = cut(out.withColumn("id", F.xxhash64(*content)))
    located = with_lines(out, locations)
    return located.select(F.xxhash64("id", "geom").alias("id"), *columns, "nodes", "ways", "geom")


@dataclass
class SegmentsTable:
    """Segments of the ways of a source with equal property columns.

    An update takes out every segment that a changed way or a node of one touches, pulls in the ways
    of those segments until no more segments come, and builds those ways anew; intersections are
    counted over all ways at their nodes. Changes are D and A only: a segment never changes in place.
    """

    source: Source
    columns: list[str]
    nodes: Source | None = None

    def _locations(self) -> DataFrame | None:
        return None if self.nodes is None else self.nodes.data

    def construct(self) -> DataFrame:
        return segments(self.source.data, self.columns, self._locations())

    def update(self, old: DataFrame) -> Source:
        ways, moved = self.source.data, cut(changed(self.source))
        hold = lambda array, ids: holding(old, array, ids)
        nodes_of = lambda df: df.select(F.explode("nodes").alias("id")).where("id IS NOT NULL").distinct()
        alive = added_or_modified(self.source)
        dirty = nodes_of(ways.join(alive, "id", "left_semi")).unionByName(nodes_of(old.join(hold("ways", moved), "id", "left_semi"))).distinct()
        if self.nodes is not None:
            dirty = dirty.unionByName(changed(self.nodes)).distinct()
        dirty = cut(dirty)
        gone = cut(hold("nodes", dirty).unionByName(hold("ways", moved)).distinct())
        scope = holding(ways, "nodes", dirty).unionByName(alive)
        while True:
            pulled = old.join(gone, "id", "left_semi").select(F.explode("ways").alias("id"))
            scope = cut(scope.unionByName(pulled).distinct())
            more = cut(gone.unionByName(hold("ways", scope)).distinct())
            if more.count() == gone.count():
                break
            gone = more
        part = ways.join(scope, "id", "left_semi")
        around = ways.join(holding(ways, "nodes", nodes_of(part)), "id", "left_semi")
        fresh = cut(segments(part, self.columns, self._locations(), around))
        before = gone.join(fresh.select("id"), "id", "left_anti").select("id", F.lit(DELETE).alias("action"))
        after = fresh.select("id").join(old.select("id"), "id", "left_anti").select("id", F.lit(ADD).alias("action"))
        fresh = fresh.select(*old.columns)
        return Source(old.join(gone, "id", "left_anti").unionByName(fresh), before.unionByName(after), fresh.join(after, "id", "left_semi"))
