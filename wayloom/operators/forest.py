"""Parent-child links to full hierarchies.

Weighted disjoint sets find the weakly connected components: each partition joins its own links,
every vertex with its offset (depth) from the root of its set; sets of different partitions that
share a vertex become links of the next, smaller round, until none is left. A component whose
offsets agree on every link has no cycle, and the depth of a vertex below a root is the difference of
their offsets. There, paths are materialised by going up an index of parents from every vertex; where
offsets contradict each other, by going down from the roots, as ways up may end in a cycle. Components
with many paths are split by the beginnings of their paths; components too large for a task are walked
level by level by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.session import cut

#: Links of a component that one task walks. It changes where a component is walked, not the result.
TASK_LINKS = 200_000
#: Paths of a component that one task gives; components with more are split.
TASK_PATHS = 1_000_000
#: Vertices at the beginning of a path that decide which task of a split component goes on with it.
PREFIX = 3
#: Tasks that a component is split into at most, and where the number of its paths is not known.
MOST_SPLITS, SPLITS = 4_096, 256
#: Links that one task joins in the merging rounds.
MERGE_LINKS = 500_000
FOUND = "kind string, id bigint, root bigint, depth int, path string"


class WeightedSets:
    """Disjoint sets in which every vertex knows its offset from its root."""

    def __init__(self, salt: int):
        self.salt, self.parent, self.offset, self.broken = salt, {}, {}, set()

    def rank(self, v: int) -> tuple[int, int]:
        return xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), self.salt), v

    def find(self, v: int) -> tuple[int, int]:
        """Root and offset; the way is compressed."""
        way, total = [], 0
        if v not in self.parent:
            self.parent[v], self.offset[v] = v, 0
        while self.parent[v] != v:
            way.append(v)
            v = self.parent[v]
        for x in reversed(way):
            total = self.offset[x] = self.offset[x] + total
            self.parent[x] = v
        return v, total

    def join(self, a: int, b: int, weight: int) -> None:
        """offset(b) - offset(a) = weight. A link that contradicts its set marks the set."""
        (ra, oa), (rb, ob) = self.find(a), self.find(b)
        if ra == rb:
            if ob - oa != weight:
                self.broken.add(ra)
            return
        shift = oa + weight - ob  # offset of rb from ra
        if self.rank(ra) > self.rank(rb):
            ra, rb, shift = rb, ra, -shift
        self.parent[rb], self.offset[rb] = ra, shift
        if rb in self.broken:
            self.broken.add(ra)


def _local_sets(links: DataFrame, salt: int) -> DataFrame:
    """(vertex, root, offset, broken) of the sets that each partition forms of its links (a, b, weight)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = WeightedSets(salt)
        for part in parts:
            for a, b, w in zip(part["a"].tolist(), part["b"].tolist(), part["weight"].tolist()):
                sets.join(a, b, w)
        all_ = list(sets.parent)
        for i in range(0, len(all_), 100_000):
            some = all_[i : i + 100_000]
            found = [sets.find(v) for v in some]
            roots = [r for r, _ in found]
            yield pd.DataFrame({"vertex": some, "root": roots, "offset": [o for _, o in found], "broken": [r in sets.broken for r in roots]})

    return links.mapInPandas(run, "vertex bigint, root bigint, offset bigint, broken boolean")


def components(links: DataFrame) -> DataFrame:
    """(vertex, component, offset, broken) for links (parent, child).

    offset is the depth from the component's root vertex; broken: some link contradicts the offsets.
    The first round's tasks are those of the links as they come; later rounds have tasks of MERGE_LINKS
    links, and a set with more of them than that is spread over several. Roots are chosen by a hash that
    changes with the round, so that chains shrink by a constant factor however long they are.
    """
    edges = links.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(1).cast("long").alias("weight"))
    levels, n = [], 0
    while True:
        sets = cut(_local_sets(edges, n))
        w = Window.partitionBy("vertex").orderBy("root", "offset")
        first = sets.select(
            "vertex", "root", "offset", "broken",
            F.first("root").over(w).alias("a"), F.first("offset").over(w).alias("own"), F.row_number().over(w).alias("k"),
        )
        first = cut(first)
        levels.append(first.where("k = 1").select("vertex", F.col("a").alias("root"), F.col("own").alias("offset")))
        # A self-link of a root with a weight keeps the contradiction of its set for the next round.
        edges = first.where((F.col("k") > 1) & ((F.col("root") != F.col("a")) | (F.col("offset") != F.col("own")))).select(
            "a", F.col("root").alias("b"), (F.col("own") - F.col("offset")).alias("weight")
        ).unionByName(
            first.where("broken").select(F.col("root").alias("a"), F.col("root").alias("b"), F.lit(1).cast("long").alias("weight"))
        ).distinct()
        real = edges.where("a != b").count()
        if not real:
            broken = edges.select(F.col("a").alias("root")).distinct().withColumn("broken", F.lit(True))
            break
        n += 1
        tasks = max(1, -(-real // MERGE_LINKS))
        if tasks == 1:
            edges = edges.coalesce(1)
        else:
            hot = edges.groupBy("a").count().where(F.col("count") > MERGE_LINKS).select("a", F.ceil(F.col("count") / MERGE_LINKS).alias("parts"))
            part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
            edges = edges.join(hot, "a", "left").withColumn("part", part).repartition(tasks, "a", "part").select("a", "b", "weight")
    out = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("vertex").alias("root"), F.col("root").alias("next"), F.col("offset").alias("more"))
        out = out.join(up, "root", "left").select(
            "vertex", F.coalesce("next", "root").alias("root"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")
        )
    return out.join(broken, "root", "left").select(
        "vertex", F.col("root").alias("component"), "offset", F.coalesce("broken", F.lit(False)).alias("broken")
    )


def strong_sets(children: dict[int, list[int]]) -> Iterator[list[int]]:
    """Strongly connected sets of more than one vertex, without recursion."""
    order, low, on, stack, count = {}, {}, set(), [], 0
    for start in children:
        if start in order:
            continue
        work = [(start, iter(children.get(start, ())))]
        order[start] = low[start] = count
        count += 1
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for c in rest:
                if c not in order:
                    order[c] = low[c] = count
                    count += 1
                    stack.append(c)
                    on.add(c)
                    work.append((c, iter(children.get(c, ()))))
                    break
                if c in on:
                    low[v] = min(low[v], order[c])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    at = stack.index(v) if stack[-1] != v else len(stack) - 1
                    group = stack[at:]
                    del stack[at:]
                    on.difference_update(group)
                    if len(group) > 1:
                        yield group


def _trails(starts, onward: dict[int, list[int]], split: tuple[int, int] = (0, 1)) -> Iterator[list[int]]:
    """Every trail from the starts that visits no vertex twice. split (k, n): those of the k-th of n tasks, by their first vertices.

    The same list is yielded again and again, so that a trail is to be used before the next one is asked for.
    """
    own, tasks = split
    mine = lambda path: tasks == 1 or xxhash.xxh64_intdigest(repr(path[:PREFIX]).encode()) % tasks == own
    for start in starts:
        path, seen, work = [start], {start}, [iter(onward.get(start, ()))]
        if mine(path):
            yield path
        while work:
            for v in work[-1]:
                if v in seen:
                    continue
                path.append(v)
                if len(path) <= PREFIX and not mine(path):
                    if len(path) == PREFIX:
                        path.pop()
                        continue
                else:
                    yield path
                seen.add(v)
                work.append(iter(onward.get(v, ())))
                break
            else:
                work.pop()
                seen.discard(path.pop())


class Component:
    """The links of one component: its indexes of parents and of children, and offsets where they agree."""

    def __init__(self, parents: list[int], kids: list[int], offsets: list[int], broken: bool):
        self.broken, self.children, self.parents = broken, {}, {}
        self.offset: dict[int, int] = {}
        for p, c, o in zip(parents, kids, offsets):
            self.children.setdefault(p, []).append(c)
            self.parents.setdefault(c, []).append(p)
            self.offset[c] = o
            self.offset.setdefault(p, o - 1)
        self.roots = [v for v in self.children if v not in self.parents]

    def splits(self, task_paths: int) -> int:
        """Into how many tasks the component is to be split, if one gives task_paths paths."""
        if self.broken:  # simple paths are not counted but by walking them
            return SPLITS if next(islice(_trails(self.roots, self.children), task_paths, None), None) else 1
        paths: dict[int, int] = {}
        for v in sorted(self.offset, key=self.offset.get):  # parents come first
            paths[v] = sum(paths[p] for p in self.parents.get(v, ())) or 1
        return min(MOST_SPLITS, -(-sum(paths.values()) // task_paths))

    def rows(self, split: tuple[int, int]) -> Iterator[tuple[str, int, int, int, str]]:
        """Cycle and path rows."""
        if self.broken:
            if not split[0]:
                for group in strong_sets(self.children):
                    least = min(group)
                    for v in group:
                        yield "cycle", v, least, 0, ""
            for path in _trails(self.roots, self.children, split):
                yield "path", path[-1], path[0], len(path), "/".join(map(str, path))
            return
        for path in _trails(self.offset, self.parents, split):
            v, root = path[0], path[-1]
            if root not in self.parents:
                yield "path", v, root, self.offset[v] - self.offset[root] + 1, "/".join(map(str, reversed(path)))


def _by_component(links: DataFrame, give, columns: list[str], schema: str) -> DataFrame:
    """What give yields for each component and split; links: (component, broken, parent, child, offset, split, splits)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held: pd.DataFrame | None = None

        def done(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal out
            first = group.iloc[0]
            one = Component(group["parent"].tolist(), group["child"].tolist(), group["offset"].tolist(), bool(first["broken"]))
            for row in give(one, int(first["component"]), (int(first["split"]), int(first["splits"]))):
                out.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []

        for part in parts:
            if held is not None:
                part = pd.concat([held, part], ignore_index=True)
            if not len(part):
                continue
            ids, split = part["component"].to_numpy(), part["split"].to_numpy()
            borders = np.flatnonzero((ids[1:] != ids[:-1]) | (split[1:] != split[:-1])) + 1
            for a, b in zip(np.r_[0, borders[:-1]] if len(borders) else [], borders):
                yield from done(part.iloc[a:b])
            held = part.iloc[borders[-1] if len(borders) else 0 :]
        if held is not None and len(held):
            yield from done(held)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return links.repartition("component", "split").sortWithinPartitions("component", "split").mapInPandas(run, schema)


def _walk_components(links: DataFrame, task_paths: int) -> DataFrame:
    """Rows of components that fit a task: links (component, broken, parent, child, offset)."""

    def split_of(one: Component, component: int, _: tuple[int, int]) -> Iterator[tuple[int, int]]:
        if (n := one.splits(task_paths)) > 1:
            yield component, n

    def rows_of(one: Component, _: int, split: tuple[int, int]) -> Iterator[tuple]:
        return one.rows(split)

    whole = links.withColumn("split", F.lit(0)).withColumn("splits", F.lit(1))
    many = cut(_by_component(whole, split_of, ["component", "n"], "component bigint, n int"))
    if not many.isEmpty():
        n = F.coalesce("n", F.lit(1))
        whole = links.join(many, "component", "left").withColumn("splits", n).withColumn("split", F.explode(F.sequence(F.lit(0), n - 1))).drop("n")
    return _by_component(whole, rows_of, ["kind", "id", "root", "depth", "path"], FOUND)


def _paths_by_joins(links: DataFrame) -> DataFrame:
    """Path rows level by level; one join with the links for each level."""
    roots = links.join(links.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("id")).distinct()
    front = cut(roots.select("id", F.col("id").alias("root"), F.array("id").alias("path")))
    out, some = front, not front.isEmpty()
    while some:
        step = front.join(links.select(F.col("parent").alias("id"), F.col("child")), "id").where(~F.array_contains("path", F.col("child")))
        front = cut(step.select(F.col("child").alias("id"), "root", F.concat("path", F.array("child")).alias("path")))
        some = not front.isEmpty()
        if some:
            out = out.unionByName(front)
    return out.select(
        F.lit("path").alias("kind"), "id", "root", F.size("path").alias("depth"),
        F.array_join(F.transform("path", lambda v: v.cast("string")), "/").alias("path"),
    )


def _spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (v, label): each vertex takes the least label among those that reach it over edges (a, b)."""
    while True:
        sent = edges.join(labels.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "label")
        new = cut(labels.unionByName(sent).groupBy("v").agg(F.min("label").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), "v").where("label != old").isEmpty():
            return new
        labels = new


def _cycles_by_joins(links: DataFrame) -> DataFrame:
    """Cycle rows: vertices without a way in or out are peeled off; what remains is coloured by the
    least vertex that reaches it, and those of a colour that reach their colour form a strong set."""
    edges, found = cut(links.select(F.col("parent").alias("a"), F.col("child").alias("b"))), None
    left = edges.count()
    while left:
        kept = cut(
            edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            .join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        )
        now = kept.count()
        if now != left:
            edges, left = kept, now
            continue
        own = edges.select(F.col("a").alias("v")).distinct()
        colour = _spread_least(edges, own.withColumn("label", F.col("v")))
        c = colour.withColumnRenamed("label", "colour")
        inside = cut(
            edges.join(c.select(F.col("v").alias("a"), F.col("colour").alias("ca")), "a")
            .join(c.select(F.col("v").alias("b"), F.col("colour").alias("cb")), "b")
            .where("ca = cb")
            .select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("colour"))
        )
        back = cut(c.where("v = colour").select("v", F.col("colour").alias("label")))
        while True:
            sent = inside.join(back.withColumnRenamed("v", "a"), "a").where("label = colour").select(F.col("b").alias("v"), "label")
            new = cut(back.unionByName(sent).distinct())
            if new.count() == back.count():
                break
            back = new
        many = back.groupBy("label").count().where("count > 1").select("label")
        rows = cut(back.join(many, "label").select("v", "label"))
        found = rows if found is None else found.unionByName(rows)
        gone = back.select("v")
        edges = cut(
            edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti")
        )
        left = edges.count()
    if found is None:
        found = links.sparkSession.createDataFrame([], "v bigint, label bigint")
    return found.select(
        F.lit("cycle").alias("kind"), F.col("v").alias("id"), F.col("label").alias("root"), F.lit(0).alias("depth"), F.lit("").alias("path")
    )


def hierarchies(links: DataFrame, task_links: int = TASK_LINKS, task_paths: int = TASK_PATHS) -> DataFrame:
    """(kind, id, root, depth, path) for links (parent, child).

    kind path: for each vertex with children and no parent, every path from it that visits no vertex
    twice, itself included. kind cycle: each vertex that reaches itself, with the least vertex of its
    strongly connected set as root. Nulls, links of a vertex with itself and repeated links are
    dropped first. No links give an empty result.
    """
    links = cut(links.where("parent IS NOT NULL AND child IS NOT NULL AND parent != child").select("parent", "child").distinct())
    comp = components(links)
    placed = links.join(comp.select(F.col("vertex").alias("child"), "component", "offset", "broken"), "child")
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    placed = cut(placed.join(size, "component").select("component", "broken", "parent", "child", "offset", "links"))
    out = _walk_components(placed.where(F.col("links") <= task_links).drop("links"), task_paths)
    large = placed.where(F.col("links") > task_links)
    if not large.isEmpty():
        out = out.unionByName(_paths_by_joins(large.select("parent", "child"))).unionByName(
            _cycles_by_joins(large.where("broken").select("parent", "child"))
        )
    return out


def relation_links(relations: DataFrame) -> DataFrame:
    """Distinct links (parent, child) from relations (id, members), one row an id, to members of type R that are among them."""
    links = relations.select(F.col("id").alias("parent"), F.explode("members").alias("m")).where(F.upper("m.type") == "R")
    return (
        links.select("parent", F.col("m.id").alias("child"))
        .where("parent != child")
        .distinct()
        .join(relations.select(F.col("id").alias("child")), "child", "left_semi")
        .select("parent", "child")
    )
