"""Lines of the members of a relation, joined in their order to one route."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.model import LINE
from wayloom.operators.forest import components
from wayloom.operators.hierarchy import descend
from wayloom.operators.relational import members
from wayloom.session import cut

#: Members of the relations of a component that one task folds.
TASK_REFS = 200_000
Point = tuple[float, float]
Parts = list[list[Point]]


def _turned(parts: Parts) -> Parts:
    return [line[::-1] for line in reversed(parts)]


def _gap(a: Point, b: Point) -> float:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def stitch(order: list, pieces: dict[object, Parts]) -> Parts:
    """The route of the pieces in the given order of their keys; missing and empty ones are skipped.

    A piece is welded to the end of the route, turned if need be. If it does not meet the end, but
    the beginning of the route's last part that nothing has been welded to, that part is turned.
    Otherwise it becomes a part of its own, turned so that the gap is least; as the second piece, it
    may also turn the first. Of equal gaps, the one for which less is turned counts, the route before
    the piece. A piece that was turned for a gap stays turned where it comes again.
    """
    route: Parts = []
    loose: int | None = None
    for key in order:
        piece = [line for line in pieces.get(key) or [] if line]
        if not piece:
            continue
        if not route:
            route, loose = [list(line) for line in piece], 0
            continue
        welded = False
        for turn in (False, True):
            if turn and loose is None:
                break
            tip = route[loose][0] if turn else route[-1][-1]
            ahead = piece if piece[0][0] == tip else _turned(piece) if piece[-1][-1] == tip else None
            if ahead is not None:
                if turn:
                    route[loose:] = _turned(route[loose:])
                route[-1] = route[-1] + ahead[0][1:]
                route += [list(line) for line in ahead[1:]]
                welded, loose = True, None
                break
        if welded:
            continue
        tips, heads = (route[-1][-1], route[0][0]), (piece[0][0], piece[-1][-1])
        turns = [(r, p) for r in ((0, 1) if loose == 0 else (0,)) for p in (0, 1)]
        turn_route, turn_piece = min(turns, key=lambda t: _gap(tips[t[0]], heads[t[1]]))
        route = _turned(route) if turn_route else route
        piece = _turned(piece) if turn_piece else piece
        pieces[key] = piece
        loose = len(route)
        route += [list(line) for line in piece]
    return route


def route_lines(relations: DataFrame, ways: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(id, lines): the route of each relation with at least one member that has a line.

    ways: (id, geom: a line); routes: (id, lines) of member relations. Members of type N count for
    nothing. One array of points: a line; several: a multi-line. The fold is sequential, so it runs
    in Python, one relation after the other; all else is joins.
    """
    refs = relations.select("id", F.posexplode("members").alias("place", "m")).select(
        "id", "place", F.upper("m.type").alias("kind"), F.col("m.id").alias("member")
    )
    lines = ways.select(F.lit("W").alias("kind"), F.col("id").alias("member"), F.array("geom").alias("lines"))
    if routes is not None:
        lines = lines.unionByName(routes.select(F.lit("R").alias("kind"), F.col("id").alias("member"), "lines"))
    whole = (
        refs.join(lines, ["kind", "member"])
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "kind", "member", "lines"))).alias("pieces"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for b in batches:
            out = []
            for row in b.column("pieces").to_pylist():
                pieces, order = {}, []
                for p in row:
                    key = p["kind"], p["member"]
                    order.append(key)
                    pieces[key] = [[(q["x"], q["y"]) for q in line] for line in p["lines"]]
                out.append([[{"x": x, "y": y} for x, y in line] for line in stitch(order, pieces)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "lines"])

    return whole.mapInArrow(run, f"id bigint, lines array<{LINE.simpleString()}>").where(F.size("lines") > 0)


def _links(relations: DataFrame) -> DataFrame:
    """(parent, child): each link to another relation that is there, once."""
    links = members(relations, "R").select(F.col("id").alias("parent"), F.col("member").alias("child")).where("parent != child").distinct()
    return cut(links.join(relations.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child"))


def _circles(links: DataFrame) -> DataFrame:
    """(root, member, depth): the relations that a relation shares a cycle with, at their least depth below it; itself at 1."""
    core, size = links, links.count()
    while size:  # what leads to no link, or is led to by none, is in no cycle
        core = cut(
            core.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
            .join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
            .select("parent", "child")
        )
        size, before = core.count(), size
        if size == before:
            break
    below = descend(core, None)
    back = below.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    pairs = below.join(back, ["parent", "child"]).select(F.col("parent").alias("root"), F.col("child").alias("member"), "depth")
    own = pairs.select("root", F.col("root").alias("member"), F.lit(1).alias("depth")).distinct()
    return cut(pairs.unionByName(own))


def _uncircled(relations: DataFrame, links: DataFrame) -> DataFrame:
    """(id, members) without cycles: a relation in a cycle has, for itself alone, copies of the others in it.

    As in the hierarchy, a relation is met at its least depth below the root: within the cycle only
    links from one depth to the next go on, so that all that can be reached is, and none leads back.
    Copies have ids below all others.
    """
    relations, circles = relations.select("id", "members"), _circles(links)
    if circles.isEmpty():
        return relations
    least = relations.agg(F.least(F.min("id"), F.min(F.array_min(F.transform("members", lambda m: m["id"]))))).first()[0]
    number = F.lit(least) - F.row_number().over(Window.orderBy("root", "member"))
    copies = circles.where("root != member").withColumn("copy", number)
    copies = cut(copies.unionByName(circles.where("root = member").withColumn("copy", F.col("root"))))
    refs = (
        copies.join(relations.withColumnRenamed("id", "member"), "member")
        .select("root", "depth", "copy", F.posexplode("members").alias("place", "m"))
        .withColumn("to", F.when(F.upper("m.type") == "R", F.col("m.id")))
    )
    met = copies.select("root", F.col("member").alias("to"), F.col("depth").alias("at"), F.col("copy").alias("as"))
    turned = refs.join(met, ["root", "to"], "left").where("at IS NULL OR at = depth + 1")
    m = F.col("m").withField("id", F.coalesce("as", "m.id"))
    fresh = turned.groupBy(F.col("copy").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", m.alias("m")))).alias("all"))
    rest = relations.join(circles.select(F.col("root").alias("id")).distinct(), "id", "left_anti")
    return rest.unionByName(fresh.select("id", F.transform("all", lambda x: x["m"]).alias("members")))


def folded(relations: list[dict]) -> dict[int, Parts]:
    """The routes of relations (id, pieces) that hold each other without cycles: a relation is stitched when its members are."""
    pieces_of = {r["id"]: r["pieces"] for r in relations}
    done: dict[int, Parts] = {}
    for top in pieces_of:
        todo = [top]
        while todo:
            own = pieces_of[todo[-1]]
            below = [p["member"] for p in own if p["kind"] == "R" and p["member"] != todo[-1] and p["member"] in pieces_of and p["member"] not in done]
            if todo[-1] in done or not below:
                v = todo.pop()
                if v not in done:
                    lines = lambda p: done.get(p["member"], []) if p["kind"] == "R" else [[(q["x"], q["y"]) for q in line] for line in p["lines"]]
                    pieces = {(p["kind"], p["member"]): [list(line) for line in lines(p)] for p in own}
                    done[v] = stitch([(p["kind"], p["member"]) for p in own], pieces)
            else:
                todo.extend(below)
    return done


def _in_tasks(relations: DataFrame, ways: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, lines) of relations without cycles; comp: (id, component). A task folds whole components."""
    refs = relations.select("id", F.posexplode("members").alias("place", "m")).select(
        "id", "place", F.upper("m.type").alias("kind"), F.col("m.id").alias("member")
    )
    lines = ways.select(F.col("id").alias("member"), F.array("geom").alias("lines"))
    own = refs.where("kind = 'W'").join(lines, "member").select("id", "place", "kind", "member", "lines")
    held = refs.where("kind = 'R'").withColumn("lines", F.lit(None).cast(lines.schema["lines"].dataType))
    whole = own.unionByName(held).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "member", "lines"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            routes = folded(held)
            lists = [[[{"x": x, "y": y} for x, y in line] for line in parts] for parts in routes.values()]
            return pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(lists, kind)], ["id", "lines"])

        for b in batches:
            for row in b.to_pylist():
                if held and row["component"] != held[0]["component"]:
                    yield out()
                    held.clear()
                held.append(row)
        if held:
            yield out()

    bucketed = whole.join(comp, "id").select("component", "id", "pieces").repartition("component").sortWithinPartitions("component")
    return bucketed.mapInArrow(run, f"id bigint, lines array<{LINE.simpleString()}>").where(F.size("lines") > 0)


def nested_route_lines(relations: DataFrame, ways: DataFrame, task_refs: int = TASK_REFS) -> DataFrame:
    """(id, lines): as route_lines, with the routes of member relations, at any depth.

    Relations that hang together are folded within a task, as long as they have no more than task_refs
    members in all; larger components from the bottom up, where a round takes the relations whose
    member relations are all done. Both give the same. For relations in cycles see _uncircled.
    """
    whole = cut(_uncircled(relations, _links(relations)))
    used = members(whole, "W").select(F.col("member").alias("id")).distinct()
    ways = cut(ways.select("id", "geom").join(used, "id", "left_semi"))
    found = components(_links(whole)).select(F.col("vertex").alias("id"), "component")
    comp = cut(whole.select("id", F.size("members").alias("refs")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "refs"))
    large = comp.groupBy("component").agg(F.sum("refs").alias("refs")).where(F.col("refs") > task_refs).select("component")
    apart = cut(comp.join(large, "component", "left_semi").select("id"))
    if apart.isEmpty():
        routes = _in_tasks(whole, ways, comp.select("id", "component"))
    else:
        small = comp.join(apart, "id", "left_anti").select("id", "component")
        routes = _in_tasks(whole, ways, small).unionByName(_in_rounds(whole.join(apart, "id", "left_semi"), ways))
    return routes.join(relations.select("id"), "id", "left_semi")


def _in_rounds(waiting: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, lines) of relations without cycles, from the bottom up."""
    waiting = cut(waiting)
    rest, routes = _links(waiting), None
    while True:
        above = rest.select(F.col("parent").alias("id")).distinct()
        level = cut(route_lines(waiting.join(above, "id", "left_anti"), ways, routes))
        routes = level if routes is None else routes.unionByName(level)
        if rest.isEmpty():
            return routes
        waiting = cut(waiting.join(above, "id", "left_semi"))
        rest = cut(rest.join(waiting.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child"))
