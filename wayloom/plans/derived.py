"""Queries of the derived tables and scalar functions over the map tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo, tags, tiles
from wayloom.model import DELETE, MODIFY, Source, current_rows, read
from wayloom.operators import relational as rel
from wayloom.operators.filtered import FilteredTable
from wayloom.operators.groups import GroupedWayTable
from wayloom.operators.hierarchy import RelationHierarchy
from wayloom.operators.increment import latest_marks
from wayloom.operators.orphans import SLOT_BITS, key_slots, parent_rows
from wayloom.operators.route import nested_route_lines
from wayloom.operators.segments import SegmentsTable, intersections
from wayloom.operators.tiling import find_tiles, plan_tiles
from wayloom.operators.transformed import TransformedTable
from wayloom.operators.ways import PlainWayTable, RelationWayTable
from wayloom.plans.pipeline import Pipeline
from wayloom.plans.pipelines import current_sql
from wayloom.session import cut, fresh_folder
from wayloom.sources import opl
from wayloom.sources.snapshot import StatusManager

#: The sequence that parts the old snapshot from the batch of changes in the queries of updates.
BEFORE = 4600
COLUMNS = {"nodes": ["tags", "x", "y"], "ways": ["tags", "nodes"], "relations": ["tags", "members"]}


def now(spark: SparkSession, d: str, table: str, before: int | None = None) -> DataFrame:
    """A table's current, visible rows; before: as of the rows with a lower sequence."""
    rows = read(spark, d, table)
    if before is not None:
        rows = rows.where(F.coalesce("sequence", F.lit(0)) < before)
    return current_rows(rows, [*COLUMNS[table], "visible"]).where("visible").drop("visible")


def batch(spark: SparkSession, d: str, table: str) -> DataFrame:
    """(id, action) of the rows from BEFORE on: C, M or D as the current row says."""
    rows = read(spark, d, table)
    ids = rows.where(F.coalesce("sequence", F.lit(0)) >= BEFORE).select("id").where("id IS NOT NULL").distinct()
    return current_rows(rows, ["visible", "version"]).join(ids, "id", "left_semi").select("id", opl.action().alias("action"))


def located(df: DataFrame) -> DataFrame:
    """Rows with a place on earth."""
    return df.where("x BETWEEN -180 AND 180 AND y BETWEEN -85 AND 85 AND NOT (x = 0 AND y = 0)")


def text(df: DataFrame) -> DataFrame:
    """Maps and arrays as text, for comparison by value."""
    out = df
    for f in df.schema.fields:
        if f.dataType.typeName() == "map":
            entries = F.transform(F.array_sort(F.map_entries(f.name)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))
            out = out.withColumn(f.name, F.array_join(entries, "|"))
        elif f.dataType.typeName() == "array":
            out = out.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), ","))
    return out


def ends(line: str) -> list[Column]:
    """Number of points of a line, and its ends in ten-millionths of a degree."""
    return [
        F.size(line).alias("points"),
        *(F.floor(F.element_at(line, at)[c] * 1e7 + 0.5).cast("long").alias(f"{n}_{c}") for n, at in (("first", 1), ("last", -1)) for c in "xy"),
    ]


def filtered_full(spark, d):
    return FilteredTable(Source(now(spark, d, "relations")), "map_contains_key(tags, 'name')").construct().select("id")


def filtered_update(spark, d):
    make = lambda rows, change=None: FilteredTable(Source(rows, change), "map_contains_key(tags, 'name')")
    old = make(now(spark, d, "relations", BEFORE)).construct()
    return make(now(spark, d, "relations"), batch(spark, d, "relations")).update(old).change


def filtered_view_change(spark, d):
    source = Source(now(spark, d, "relations"), batch(spark, d, "relations"))
    return FilteredTable(source, "map_contains_key(tags, 'name')", view=True).update().change


def _transform(source: Source) -> TransformedTable:
    t = lambda k: F.try_element_at("tags", F.lit(k))
    return TransformedTable(source, {"name": t("name"), "capacity": t("capacity").try_cast("int"), "kind": F.coalesce(t("amenity"), t("shop"), F.lit("none"))}, t("name").isNotNull())


def transformed(spark, d):
    return _transform(Source(now(spark, d, "nodes"))).construct()


def transformed_update(spark, d):
    old = _transform(Source(now(spark, d, "nodes", BEFORE))).construct()
    return _transform(Source(now(spark, d, "nodes"), batch(spark, d, "nodes"))).update(old).change


def _plain(spark, d, before=None, change=False) -> PlainWayTable:
    ways, nodes = now(spark, d, "ways", before), located(now(spark, d, "nodes", before))
    c = (lambda t: batch(spark, d, t)) if change else lambda t: None
    return PlainWayTable(Source(ways, c("ways")), Source(nodes, c("nodes")))


def plain_way_geom(spark, d):
    return _plain(spark, d).construct().select("id", F.size("nodes").alias("nodes"), *ends("geom"))


def plain_way_update(spark, d):
    return _plain(spark, d, change=True).update(_plain(spark, d, BEFORE).construct()).change


def plain_way_mercator(spark, d):
    table = _plain(spark, d)
    table.mercator = True
    line = table.construct()
    return line.select("id", *(F.round(F.get("geom", 0)[c], 3).alias(f"m{c}") for c in "xy"))


def _relation_ways(spark, d, before=None, change=False, geometry=False) -> RelationWayTable:
    c = (lambda t: batch(spark, d, t)) if change else lambda t: None
    nodes = Source(located(now(spark, d, "nodes", before)), c("nodes")) if geometry else None
    return RelationWayTable(Source(now(spark, d, "ways", before), c("ways")), Source(now(spark, d, "relations", before), c("relations")), nodes)


def relation_ways(spark, d):
    return text(_relation_ways(spark, d).construct().select("id", "nodes", "rels"))


def relation_ways_geom(spark, d):
    return text(_relation_ways(spark, d, geometry=True).construct().select("id", "rels", *ends("geom")))


def relation_ways_update(spark, d):
    """The table after an incremental update: the rows that a construction on the new snapshot gives."""
    old = _relation_ways(spark, d, BEFORE).construct()
    return text(_relation_ways(spark, d, change=True).update(old).data.select("id", "nodes", "rels"))


def relation_ways_changes(spark, d):
    """The changes that an update reports."""
    return _relation_ways(spark, d, change=True).update(_relation_ways(spark, d, BEFORE).construct()).change


def hierarchy_update(spark, d):
    """The changes (parent, child, action) of an update."""
    old = RelationHierarchy(Source(now(spark, d, "relations", BEFORE))).construct()
    return RelationHierarchy(Source(now(spark, d, "relations"), batch(spark, d, "relations"))).update(old).change


def hierarchy(spark, d):
    return RelationHierarchy(Source(now(spark, d, "relations"))).construct()


def hierarchy_closure(spark, d):
    """Every ancestor and descendant at its least depth, however deep."""
    return RelationHierarchy(Source(now(spark, d, "relations")), depths=None).construct()


def _kind(ways: DataFrame) -> DataFrame:
    return ways.select("id", "nodes", F.try_element_at("tags", F.lit("highway")).alias("highway"))


def grouped_ways(spark, d):
    return GroupedWayTable(Source(_kind(now(spark, d, "ways"))), ["highway"]).construct()


def grouped_ways_update(spark, d):
    """The groups after an update, each under its least member, as the ids depend on what was before."""
    old = GroupedWayTable(Source(_kind(now(spark, d, "ways", BEFORE))), ["highway"]).construct()
    new = GroupedWayTable(Source(_kind(now(spark, d, "ways")), batch(spark, d, "ways")), ["highway"]).update(old).data
    least = new.groupBy("id").agg(F.min("child").alias("least"))
    return new.join(least, "id").select(F.col("least").alias("id"), "child")


def segments_intersections(spark, d):
    ways = now(spark, d, "ways").withColumn("nodes", F.array_compact("nodes")).where(F.size("nodes") > 1)
    return intersections(ways)


def segments(spark, d):
    """Rows without SQL: checked by tests and by segments_lengths."""
    return text(SegmentsTable(Source(_kind(now(spark, d, "ways"))), ["highway"]).construct().select("highway", "nodes", "ways"))


def segments_update(spark, d):
    """As segments_lengths, of the table after an update."""
    old = cut(SegmentsTable(Source(_kind(now(spark, d, "ways", BEFORE))), ["highway"]).construct())
    table = SegmentsTable(Source(_kind(now(spark, d, "ways")), batch(spark, d, "ways")), ["highway"]).update(old).data
    return table.groupBy("highway").agg(F.sum(F.size("nodes") - 1).alias("stretches"))


def segments_lengths(spark, d):
    """What cutting and joining leave as it was: the stretches between neighbouring nodes, by property."""
    table = SegmentsTable(Source(_kind(now(spark, d, "ways"))), ["highway"]).construct()
    return table.groupBy("highway").agg(F.sum(F.size("nodes") - 1).alias("stretches"))


def route_geometry(spark, d):
    lines = _plain(spark, d).construct().select("id", "geom")
    routes = nested_route_lines(now(spark, d, "relations"), lines)
    return routes.select("id", F.size("lines").alias("parts"), F.aggregate("lines", F.lit(0), lambda n, line: n + F.size(line)).alias("points"))


def tag_functions(spark, d):
    t = F.col("tags")
    ways = now(spark, d, "ways")
    return ways.select(
        "id", tags.first_of(t, "highway", "name", default="none").alias("first"), tags.length(t, "width", "distance", unit="m", default="m").alias("width"),
        F.size(tags.booleans(t)).alias("booleans"), F.size(tags.with_prefix(t, "name")).alias("named"),
    )


def _made_tags(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select(
        F.col("r_regionkey").cast("long").alias("id"),
        F.create_map(
            F.lit("name"), F.col("r_name"), F.lit("name:de"), F.concat(F.lit("de "), "r_name"), F.lit("name:fr"), F.concat(F.lit("fr "), "r_name"),
            F.lit("wikipedia"), F.concat(F.lit("de:"), "r_name", F.lit(" x*y")), F.lit("website"), F.concat(F.lit("http://a.b/'"), "r_name"),
        ).alias("tags"),
    )


def _links_of(df: DataFrame, *key: str) -> DataFrame:
    t = F.col("tags")
    return df.select(
        *key, tags.localized(t, ["fr", "de"])["name"].alias("name"), tags.wikipedia_url(t).alias("page"),
        tags.wikipedia_pages(t)["de"].alias("title"), tags.url(t).alias("url"),
    )


def tag_links(spark, d):
    """Localised names and links of made-up tags, as the map data have none."""
    return _links_of(_made_tags(spark, d), "id")


def tag_links_all(spark, d):
    """As tag_links, for all current nodes, ways and relations. Ids that end in the key of a region
    have its made-up tags too, where they have none of the name; all others have their own tags alone."""
    made = _made_tags(spark, d).select(F.col("id").alias("end"), F.col("tags").alias("made"))
    own = lambda obj, table: now(spark, d, table).select(F.lit(obj).alias("obj"), "id", "tags")
    every = own("node", "nodes").unionByName(own("way", "ways")).unionByName(own("relation", "relations"))
    held = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(held, F.map_filter("made", lambda k, v: ~F.map_contains_key(held, k)))
    both = every.withColumn("end", F.pmod("id", F.lit(10))).join(made, "end", "left")
    return _links_of(both.withColumn("tags", F.when(F.col("made").isNull(), F.col("tags")).otherwise(merged)), "obj", "id")


def tile_numbers(spark, d):
    nodes = located(now(spark, d, "nodes"))
    z = F.lit(12)
    x, y = tiles.tile_column(geo.mercator_x(F.col("x")), z), tiles.tile_row(geo.mercator_y(F.col("y")), z)
    box = tiles.tile_box(z, x, y)
    return nodes.select("id", tiles.tile_id(z, x, y).alias("tile"), F.round(box["x0"], 3).alias("x0"), F.round(box["y1"], 3).alias("y1"), tiles.tile_path(z, x, y, False).alias("path"))


def tile_plan(spark, d):
    """The tiles of all lines that the batch changed, through the way or through its nodes: where they were and where they are."""
    before, after = _plain(spark, d, BEFORE), _plain(spark, d, change=True)
    before.mercator = after.mercator = True
    old = cut(before.construct())
    new = after.update(old)
    change, put = new.change, cut(new.rows)
    data = old.join(change, "id", "left_anti").unionByName(put)
    both = old.join(change, "id", "left_semi").unionByName(put).select("geom").distinct()
    return plan_tiles(data, both, 0, 8, 5)


def tile_lookup(spark, d):
    """For each current node, the tile at zoom 10 to the right of its own, asked of a store of all nodes' tiles down to zoom 8, with pictures down to zoom 5."""
    nodes = located(now(spark, d, "nodes")).select("id", geo.mercator_x(F.col("x")).alias("mx"), geo.mercator_y(F.col("y")).alias("my"))
    at = lambda z: (tiles.tile_column(F.col("mx"), z), tiles.tile_row(F.col("my"), z))
    zooms = nodes.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(8))))
    store = zooms.select("zoom", tiles.tile_id(F.col("zoom"), *at(F.col("zoom"))).alias("id")).distinct()
    store = store.select("id", F.when(F.col("zoom") <= 5, F.col("id").cast("string")).alias("pixbuf"))
    x, y = at(F.lit(10))
    asked = nodes.select("id", F.lit(10).alias("zoom"), F.pmod(x + 1, F.lit(1024)).alias("x"), y.alias("y"))
    asked = asked.unionByName(nodes.select("id", F.lit(5).alias("zoom"), *(c.alias(n) for c, n in zip(at(F.lit(5)), "xy"))))
    return find_tiles(store, asked, 8)


def node_ewkb(spark, d):
    """The extended WKB of each current node's place, made here; the SQL reads what the table holds."""
    nodes = current_rows(read(spark, d, "nodes"), ["x", "y", "visible", "geom"]).where("visible AND geom IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    return nodes.select("id", geo.ewkb_point(F.col("x"), F.col("y")).alias("ewkb"))


def change_diff(spark, d):
    return rel.difference(now(spark, d, "relations", BEFORE), now(spark, d, "relations"))


def apply_upsert(spark, d):
    """The old relations after the batch: ids and number of members."""
    change = batch(spark, d, "relations")
    new = now(spark, d, "relations").join(change, "id")
    gone = change.where("action = 'D'").join(new.select("id"), "id", "left_anti")
    whole = new.unionByName(gone.select("id", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast(new.schema["members"].dataType).alias("members"), "action"))
    return rel.apply_changes(now(spark, d, "relations", BEFORE), whole).select("id", F.size("members").alias("members"))


def status_min_sequence(spark, d):
    return latest_marks(read(spark, d, "status")).agg(F.min("sequence").alias("sequence"))


def feed_actions(spark, d):
    """The last action of each node in the feed."""
    feed = read(spark, d, "node_changeset")
    return rel.last_actions(feed, "version").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def parents_seen(spark, d):
    slots = key_slots(parent_rows(read(spark, d, "ways"), "W"))
    each = slots.select("slots", F.posexplode("states").alias("i", "state")).where("state > 0")
    return each.select((F.shiftleft("slots", SLOT_BITS) + F.col("i")).alias("key"), (F.col("state") == 2).alias("deleted"))


def pipeline_lines(spark, d):
    """Lines of the ways with a highway, kept by a pipeline: loaded and built as before the batch, which is then applied."""
    p = Pipeline(spark, fresh_folder(spark, "pipeline"))
    p.add_table("roads", lambda p: FilteredTable(p.source("way"), "map_contains_key(tags, 'highway')"))
    p.add_table("lines", lambda p: PlainWayTable(p.source("roads"), p.source("node")))
    base = {"node": "nodes", "way": "ways", "relation": "relations"}
    place = lambda df, name: located(df) if name == "node" else df
    p.load({name: place(now(spark, d, table, BEFORE), name) for name, table in base.items()}, BEFORE - 1)
    p.construct()
    changes = {}
    for name, table in base.items():
        fresh, ids = place(now(spark, d, table), name), batch(spark, d, table).select("id")
        kept = fresh.join(ids, "id", "left_semi").withColumn("action", F.lit(MODIFY))
        gone = ids.join(fresh, "id", "left_anti").select("id", *(F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns if c != "id"), F.lit(DELETE).alias("action"))
        changes[name] = kept.unionByName(gone)
    p.apply(changes, BEFORE)
    return p.source("lines").data.select("id", F.size("nodes").alias("nodes"), *ends("geom"))


def opl_round_trip(spark, d):
    """All current objects, written as lines of text and read again."""
    none = lambda kind: F.lit(None).cast(kind)
    out = None
    for kind, table in (("N", "nodes"), ("W", "ways"), ("R", "relations")):
        rows = current_rows(read(spark, d, table), [*COLUMNS[table], "visible", "version", "uid"])
        own = {"x": "double", "y": "double", "nodes": "array<bigint>", "members": "array<struct<id:bigint,role:string,type:string>>", "date": "timestamp"}
        rows = rows.withColumns({c: none(t) for c, t in own.items() if c not in rows.columns}).withColumn("kind", F.lit(kind))
        rows = rows.select("kind", "id", "version", "visible", "date", "uid", "tags", "x", "y", "nodes", "members")
        out = rows if out is None else out.unionByName(rows)
    again = opl.parse(opl.render(out.withColumn("members", F.lit(None).cast(out.schema["members"].dataType))))
    return text(again.select("kind", "id", "version", "visible", "uid", "tags", "x", "y", "nodes"))


def status_table(spark, d):
    """The marks of all parts through a status manager."""
    status = StatusManager()
    for r in latest_marks(read(spark, d, "status")).collect():
        status.set_status(r.part, r.date, r.sequence)
    return status.table(spark).select("part", "sequence", F.unix_micros("date").alias("micros"))


def node_functions(spark, d):
    """Split paths of the tiles of nodes at zoom 12, and squared distances from their tile's upper left corner in degrees."""
    nodes, z = located(now(spark, d, "nodes")), F.lit(12)
    x, y = tiles.tile_column(geo.mercator_x(F.col("x")), z), tiles.tile_row(geo.mercator_y(F.col("y")), z)
    apart = geo.squared_distance(F.col("x"), F.col("y"), F.floor("x"), F.floor("y"))
    return nodes.select("id", tiles.tile_path(z, x, y, True).alias("path"), tiles.ancestor(x, 4).alias("above"), F.round(apart, 9).alias("apart"))


def _was(table: str, columns: str) -> str:
    return current_sql(f"(SELECT * FROM {table} WHERE coalesce(sequence, 0) < {BEFORE})", columns)


def _batch_sql(table: str) -> str:
    return (
        "(SELECT id, CASE WHEN NOT visible THEN 'D' WHEN version = 1 THEN 'C' ELSE 'M' END AS action FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY id ORDER BY version DESC, sequence DESC) AS rn FROM {table}) WHERE rn = 1 AND id IN (SELECT id FROM {table} WHERE coalesce(sequence, 0) >= {BEFORE}))"
    )


def _named(rows: str) -> str:
    return f"(SELECT id FROM {rows} WHERE list_contains(map_keys(tags), 'name'))"


def _lines_sql(ways: str, nodes: str) -> str:
    """Places of each way's nodes in order; the nudge of equal neighbours is far below the rounding."""
    return (
        f"(SELECT w.id, w.n, any_value(w.nodes) AS nodes, list({{'x': p.x, 'y': p.y}} ORDER BY w.place) AS geom FROM (SELECT id, nodes, len(nodes) AS n, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS place FROM {ways}) w "
        f"JOIN (SELECT * FROM {nodes} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -85 AND 85 AND NOT (x = 0 AND y = 0)) p ON p.id = w.node GROUP BY w.id, w.n HAVING count(*) > 1)"
    )


_ENDS = "len(geom)::INT AS points, " + ", ".join(f"floor(geom[{i}].{c} * 1e7 + 0.5)::BIGINT AS {n}_{c}" for n, i in (("first", 1), ("last", -1)) for c in "xy")
_WAYS, _NODES, _RELS = current_sql("ways", "id, tags, nodes"), current_sql("nodes", "id, tags, x, y"), current_sql("relations", "id, tags, members")
_OLD_WAYS, _OLD_NODES, _OLD_RELS = _was("ways", "id, tags, nodes"), _was("nodes", "id, tags, x, y"), _was("relations", "id, tags, members")


def _relways(rels: str) -> str:
    """Each way with the sorted ids of the relations that hold it."""
    return f"""(SELECT way, list_sort(list(DISTINCT rel)) AS rels FROM (SELECT id AS rel, m.id AS way FROM (SELECT id, unnest(members) AS m FROM {rels})
  WHERE upper(m.type) = 'W' AND m.id IS NOT NULL) GROUP BY way)"""


def _rlinks(rels: str) -> str:
    return f"(SELECT DISTINCT id AS p, m.id AS c FROM (SELECT id, unnest(members) AS m FROM {rels}) WHERE upper(m.type) = 'R' AND m.id IS NOT NULL AND m.id <> id)"


def _levels_sql(links: str, most: int) -> str:
    """(parent, child, depth) of all pairs, at their least depth."""
    return (
        f"(WITH RECURSIVE l AS {links}, walk AS (SELECT p, c, 2 AS depth FROM l UNION SELECT w.p, l.c, w.depth + 1 FROM walk w JOIN l ON l.p = w.c WHERE w.depth < {most}) "
        "SELECT p AS parent, c AS child, min(depth)::INT AS depth FROM walk WHERE p <> c GROUP BY p, c)"
    )


_RELWAYS, _RLINKS = _relways(_RELS), _rlinks(_RELS)


def _tag(key: str) -> str:
    return f"tags['{key}']"


def _change_sql(old: str, new: str, columns: str) -> str:
    return f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'A' WHEN n.id IS NULL THEN 'D' ELSE 'M' END AS action
  FROM (SELECT id, {columns} AS v FROM {old}) o FULL JOIN (SELECT id, {columns} AS v FROM {new}) n ON o.id = n.id
  WHERE o.id IS NULL OR n.id IS NULL OR o.v IS DISTINCT FROM n.v"""


def _transform_sql(nodes: str) -> str:
    return (
        f"(SELECT id, {_tag('name')} AS name, CASE WHEN regexp_full_match(trim({_tag('capacity')}), '[+-]?[0-9]+([.][0-9]*)?') THEN try_cast(trunc(try_cast(trim({_tag('capacity')}) AS DOUBLE)) AS INT) END AS capacity, "
        f"coalesce({_tag('amenity')}, {_tag('shop')}, 'none') AS kind FROM {nodes} WHERE {_tag('name')} IS NOT NULL)"
    )


_N12 = 4096
_MX, _MY = "radians(x) * 6378137", "ln(tan(pi() / 4 + radians(y) / 2)) * 6378137"
_TX = f"greatest(0, least({_N12 - 1}, floor(({_MX} + 20037508.34) / 40075016.68 * {_N12})))::BIGINT"
_TY = f"greatest(0, least({_N12 - 1}, floor((20037508.34 - {_MY}) / 40075016.68 * {_N12})))::BIGINT"
_WIDTH = "(40075016.68 / 4096)"
_KIND = f"(SELECT id, nodes, {_tag('highway')} AS highway FROM {_WAYS})"

_OLD_LINES, _NEW_LINES = _lines_sql(_OLD_WAYS, _OLD_NODES), _lines_sql(_WAYS, _NODES)
_OLD_RELATION_WAYS, _NEW_RELATION_WAYS = (
    f"(SELECT w.id, w.nodes, r.rels FROM {w} w JOIN {_relways(r)} r ON r.way = w.id)" for w, r in ((_OLD_WAYS, _OLD_RELS), (_WAYS, _RELS))
)
_UNIT = "CASE lower(regexp_extract(w, p, 3)) WHEN '' THEN 1.0 WHEN 'm' THEN 1.0 WHEN 'km' THEN 1000.0 WHEN 'mi' THEN 1609.3 WHEN 'ft' THEN 0.3048 WHEN chr(39) THEN 0.3048 END"


def _tiles_sql(lines: str) -> str:
    """Distinct tiles from zoom 0 to 8 that lines cross: a stretch is clipped at the sides of each tile of its box at zoom 8."""
    n, w, half = 256, "(40075016.68 / 256)", "20037508.34"
    column = lambda v: f"greatest(0, least({n - 1}, floor(({v} + {half}) / 40075016.68 * {n})))::BIGINT"
    row = lambda v: f"greatest(0, least({n - 1}, floor(({half} - {v}) / 40075016.68 * {n})))::BIGINT"

    def side(p: str, d: str, lo: str, hi: str) -> tuple[str, str]:
        begin = f"CASE WHEN {d} <> 0 THEN least(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) WHEN {p} BETWEEN {lo} AND {hi} THEN 0 ELSE 2 END"
        end = f"CASE WHEN {d} <> 0 THEN greatest(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) WHEN {p} BETWEEN {lo} AND {hi} THEN 1 ELSE -1 END"
        return begin, end

    fx, tx = side("ax", "(bx - ax)", f"(x * {w} - {half})", f"((x + 1) * {w} - {half})")
    fy, ty = side("ay", "(b_y - ay)", f"({half} - (y + 1) * {w})", f"({half} - y * {w})")
    points = f"SELECT g[i].x AS x, g[i].y AS y, g[i + 1].x AS u, g[i + 1].y AS v FROM (SELECT geom AS g, unnest(range(1, len(geom))) AS i FROM {lines})"
    projected = f"SELECT {_MX} AS ax, {_MY} AS ay, {_MX.replace('x)', 'u)')} AS bx, {_MY.replace('(y)', '(v)')} AS b_y FROM ({points})"
    wide = f"SELECT *, unnest(range(least({column('ax')}, {column('bx')}), greatest({column('ax')}, {column('bx')}) + 1)) AS x FROM ({projected})"
    boxes = f"SELECT *, unnest(range(least({row('ay')}, {row('b_y')}), greatest({row('ay')}, {row('b_y')}) + 1)) AS y FROM ({wide})"
    hit = f"SELECT DISTINCT x, y FROM ({boxes}) WHERE greatest(0, {fx}, {fy}) <= least(1, {tx}, {ty})"
    return f"(SELECT DISTINCT (8 - up)::INT AS zoom, x >> up AS x, y >> up AS y FROM (SELECT x, y, unnest(range(0, 9)) AS up FROM ({hit})))"


_CHANGED = f"(SELECT id FROM ({_change_sql(_OLD_LINES, _NEW_LINES, "{'n': nodes, 'g': geom}")}))"
_TILE_PLAN = f"""
WITH old AS {_OLD_LINES}, new AS {_NEW_LINES}, changed AS {_CHANGED},
touched AS {_tiles_sql("(SELECT geom FROM old WHERE id IN (SELECT id FROM changed) UNION ALL SELECT geom FROM new WHERE id IN (SELECT id FROM changed))")},
full_ AS {_tiles_sql("new")}
SELECT zoom + (x << 5) + (y << (zoom + 5)) AS id, zoom, x, y, CASE WHEN f.zoom IS NULL THEN 'delete' WHEN t.zoom <= 5 THEN 'render' ELSE 'reserve' END AS task
FROM touched t LEFT JOIN (SELECT zoom, x, y FROM full_) f USING (zoom, x, y)""".replace("f.zoom IS NULL", "f.x IS NULL")


def _cell(zoom: str, column: bool) -> str:
    n = f"pow(2, {zoom})"
    part = f"({_MX} + 20037508.34)" if column else f"(20037508.34 - {_MY})"
    return f"greatest(0, least({n} - 1, floor({part} / 40075016.68 * {n})))::BIGINT"


_TILE_LOOKUP = f"""
WITH n AS (SELECT id, x, y FROM {_NODES} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -85 AND 85 AND NOT (x = 0 AND y = 0)),
store AS (SELECT DISTINCT z AS zoom, {_cell("z", True)} AS tx, {_cell("z", False)} AS ty FROM (SELECT *, unnest(range(0, 9)) AS z FROM n)),
asked AS (SELECT id, 10 AS zoom, ({_cell("10", True)} + 1) % 1024 AS tx, {_cell("10", False)} AS ty FROM n UNION ALL SELECT id, 5, {_cell("5", True)}, {_cell("5", False)} FROM n)
SELECT a.id, a.zoom, a.tx AS x, a.ty AS y, CASE WHEN s.zoom IS NULL THEN 'empty' WHEN a.zoom <= 5 THEN 'stored' ELSE 'render' END AS state,
  CASE WHEN a.zoom <= 5 AND s.zoom IS NOT NULL THEN (a.zoom + (a.tx << 5) + (a.ty << (a.zoom + 5)))::VARCHAR END AS pixbuf
FROM asked a LEFT JOIN store s ON s.zoom = least(a.zoom, 8) AND s.tx = a.tx >> greatest(0, a.zoom - 8) AND s.ty = a.ty >> greatest(0, a.zoom - 8)"""


def _merged(key: str, made: str) -> str:
    """The value of a key: the object's own, where it has the key, else that of the region in which its id ends."""
    return f"CASE WHEN list_contains(map_keys(tags), '{key}') THEN tags['{key}'] WHEN r_name IS NOT NULL THEN {made} END"


_ALL_TAGS = " UNION ALL ".join(f"SELECT '{o}' AS obj, id, tags FROM {t}" for o, t in (("node", _NODES), ("way", _WAYS), ("relation", _RELS)))
_LINK_TAGS = f"""SELECT obj, id, {_merged("name", "r_name")} AS name, {_merged("name:de", "'de ' || r_name")} AS de, {_merged("name:fr", "'fr ' || r_name")} AS fr,
  {_merged("wikipedia", "'de:' || r_name || ' x*y'")} AS wiki, {_merged("url", "NULL")} AS u, {_merged("website", "'http://a.b/' || chr(39) || r_name")} AS site
  FROM ({_ALL_TAGS}) LEFT JOIN region ON r_regionkey = id % 10"""
_QUOTED = "replace(url_encode({}), '%2F', '/')"
_TAG_LINKS_ALL = f"""
WITH t AS ({_LINK_TAGS}), c AS (SELECT *, position(':' IN wiki) AS colon, replace(replace(coalesce(u, site), '"', '%22'), chr(39), '%27') AS raw FROM t),
l AS (SELECT *, CASE WHEN colon > 0 THEN left(wiki, colon - 1) END AS lang, substr(wiki, colon + 1) AS title_ FROM c)
SELECT obj, id, coalesce(fr, de, name) AS name,
  CASE WHEN colon = 0 THEN 'https://en.wikipedia.org/wiki/' || {_QUOTED.format("wiki")}
    WHEN colon > 0 AND len(lang) IN (2, 3) THEN 'https://' || lang || '.wikipedia.org/wiki/' || {_QUOTED.format("title_")} END AS page,
  CASE WHEN colon > 0 AND lang = 'de' THEN title_ END AS title,
  CASE WHEN lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+', 1)) IN ('http', 'https') THEN raw END AS url FROM l"""

_ALL_OBJECTS = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, id, version, visible, uid, tags, {x} AS x, {y} AS y, {n} AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, sequence DESC) AS rn FROM {t}) WHERE rn = 1"
    for k, t, x, y, n in (("N", "nodes", "x", "y", "NULL"), ("W", "ways", "NULL", "NULL", "nodes"), ("R", "relations", "NULL", "NULL", "NULL"))
)
_ROADS = f"(SELECT * FROM {_WAYS} WHERE list_contains(map_keys(tags), 'highway'))"
_PIECE = "CASE WHEN {0} < 1000 THEN {0} || '/o' ELSE left({0}::VARCHAR, 3) || '/' || substr({0}::VARCHAR, 4) END"

QUERIES = {
    f.__name__: f
    for f in (
        filtered_full, filtered_update, filtered_view_change, transformed, transformed_update, plain_way_geom, plain_way_update, plain_way_mercator,
        relation_ways, relation_ways_geom, relation_ways_update, hierarchy, hierarchy_closure, grouped_ways, segments_intersections, segments,
        segments_lengths, route_geometry, tag_functions, tag_links, tag_links_all, tile_numbers, tile_plan, node_ewkb, change_diff, apply_upsert,
        status_min_sequence, feed_actions, parents_seen, relation_ways_changes, hierarchy_update, grouped_ways_update, segments_update, tile_lookup,
        pipeline_lines, opl_round_trip, status_table, node_functions,
    )
}
ORACLES = {
    "filtered_full": f"SELECT id FROM {_named(_RELS)}",
    "filtered_update": f"""SELECT b.id, CASE WHEN n.id IS NULL THEN 'D' ELSE 'M' END AS action FROM {_batch_sql("relations")} b
      LEFT JOIN {_named(_RELS)} n ON n.id = b.id LEFT JOIN {_named(_was("relations", "id, tags"))} o ON o.id = b.id WHERE n.id IS NOT NULL OR o.id IS NOT NULL""",
    "filtered_view_change": f"SELECT b.id, CASE WHEN n.id IS NULL THEN 'D' ELSE b.action END AS action FROM {_batch_sql('relations')} b LEFT JOIN {_named(_RELS)} n ON n.id = b.id",
    "transformed": f"SELECT * FROM {_transform_sql(_NODES)}",
    "transformed_update": _change_sql(_transform_sql(_was("nodes", "id, tags")), _transform_sql(_NODES), "{'a': name, 'b': capacity, 'c': kind}"),
    "plain_way_geom": f"SELECT id, n::INT AS nodes, {_ENDS} FROM {_lines_sql(_WAYS, _NODES)}",
    "plain_way_mercator": f"SELECT id, round(mx, 3) AS mx, round(my, 3) AS my FROM (SELECT id, {_MX.replace('x)', 'geom[1].x)')} AS mx, {_MY.replace('(y)', '(geom[1].y)')} AS my FROM {_lines_sql(_WAYS, _NODES)})",
    "relation_ways": f"SELECT w.id, array_to_string(w.nodes, ',') AS nodes, array_to_string(r.rels, ',') AS rels FROM {_WAYS} w JOIN {_RELWAYS} r ON r.way = w.id",
    "relation_ways_geom": f"SELECT w.id, array_to_string(r.rels, ',') AS rels, {_ENDS} FROM {_lines_sql(_WAYS, _NODES)} w JOIN {_RELWAYS} r ON r.way = w.id",
    "relation_ways_update": f"SELECT w.id, array_to_string(w.nodes, ',') AS nodes, array_to_string(r.rels, ',') AS rels FROM {_WAYS} w JOIN {_RELWAYS} r ON r.way = w.id",
    "hierarchy": f"SELECT * FROM {_levels_sql(_RLINKS, 5)}",
    "hierarchy_closure": f"SELECT * FROM {_levels_sql(_RLINKS, 60)}",
    "hierarchy_update": f"""SELECT coalesce(o.parent, n.parent) AS parent, coalesce(o.child, n.child) AS child, CASE WHEN o.parent IS NULL THEN 'A' WHEN n.parent IS NULL THEN 'D' ELSE 'M' END AS action
      FROM {_levels_sql(_rlinks(_OLD_RELS), 5)} o FULL JOIN {_levels_sql(_RLINKS, 5)} n ON o.parent = n.parent AND o.child = n.child WHERE o.depth IS DISTINCT FROM n.depth""",
    "plain_way_update": _change_sql(_OLD_LINES, _NEW_LINES, "{'n': nodes, 'g': geom}"),
    "relation_ways_changes": _change_sql(_OLD_RELATION_WAYS, _NEW_RELATION_WAYS, "{'n': nodes, 'r': rels}"),
    "tag_functions": f"""SELECT id, coalesce({_tag('highway')}, {_tag('name')}, 'none') AS first,
      CASE WHEN regexp_matches(w, p) THEN try_cast(regexp_extract(w, p, 1) || '.' || CASE regexp_extract(w, p, 2) WHEN '' THEN '0' ELSE regexp_extract(w, p, 2) END AS DOUBLE) * {_UNIT} END AS width,
      len([e FOR e IN map_entries(tags) IF lower(e.value) IN ('yes', 'true', 'no', 'false')])::INT AS booleans, len([k FOR k IN map_keys(tags) IF starts_with(k, 'name')])::INT AS named
      FROM (SELECT *, coalesce({_tag('width')}, {_tag('distance')}) AS w, '^\\s*(\\d+)(?:[.,](\\d+))?\\s*([a-zA-Z' || chr(39) || ']*)' AS p FROM {_WAYS})""",
    "tag_links_all": _TAG_LINKS_ALL,
    "tile_plan": _TILE_PLAN,
    "tile_lookup": _TILE_LOOKUP,
    "grouped_ways": f"""WITH RECURSIVE w AS (SELECT DISTINCT id, highway, node FROM (SELECT id, highway, unnest(nodes) AS node FROM {_KIND}) WHERE node IS NOT NULL),
      e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM w a JOIN w b ON a.node = b.node AND a.highway IS NOT DISTINCT FROM b.highway AND a.id <> b.id),
      r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT min(b) AS id, a AS child FROM r GROUP BY a""",
    "segments_intersections": f"""SELECT node FROM (SELECT unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i, len(nodes) AS n FROM
      (SELECT [x FOR x IN nodes IF x IS NOT NULL] AS nodes FROM {_WAYS}) WHERE len(nodes) > 1) GROUP BY node HAVING sum(CASE WHEN i = 1 OR i = n THEN 1 ELSE 2 END) > 2""",
    "segments_lengths": f"SELECT highway, sum(len([x FOR x IN nodes IF x IS NOT NULL]) - 1)::BIGINT AS stretches FROM {_KIND} WHERE len([x FOR x IN nodes IF x IS NOT NULL]) > 1 GROUP BY highway",
    "tag_links": """SELECT r_regionkey::BIGINT AS id, 'fr ' || r_name AS name, 'https://de.wikipedia.org/wiki/' || replace(r_name, ' ', '%20') || '%20x%2Ay' AS page,
      r_name || ' x*y' AS title, 'http://a.b/%27' || r_name AS url FROM region""",
    "tile_numbers": f"""SELECT id, 12 + (tx << 5) + (ty << 17) AS tile, round(tx * {_WIDTH} - 20037508.34, 3) AS x0, round(20037508.34 - ty * {_WIDTH}, 3) AS y1, '12/' || tx || '/' || ty || '.png' AS path
      FROM (SELECT id, {_TX} AS tx, {_TY} AS ty FROM {_NODES} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -85 AND 85 AND NOT (x = 0 AND y = 0))""",
    "node_ewkb": f"SELECT id, lower(hex(geom)) AS ewkb FROM {current_sql('nodes', 'id, geom, x, y')} WHERE geom IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL",
    "change_diff": _change_sql(_was("relations", "id, tags, members"), _RELS, "{'t': list_sort(map_entries(tags)), 'm': members}"),
    "apply_upsert": f"SELECT id, len(members)::INT AS members FROM {_RELS}",
    "status_min_sequence": "SELECT min(s)::INT AS sequence FROM (SELECT part, max(sequence) AS s FROM status WHERE state = 'ok' AND part IS NOT NULL GROUP BY part)",
    "feed_actions": "SELECT action, count(*) AS n FROM (SELECT id, arg_max(action, version) AS action FROM node_changeset GROUP BY id) GROUP BY action",
    "parents_seen": "SELECT id AS key, NOT arg_max(visible, version) AS deleted FROM ways GROUP BY id",
}
ORACLES |= {"grouped_ways_update": ORACLES["grouped_ways"], "segments_update": ORACLES["segments_lengths"]}
ORACLES |= {
    "pipeline_lines": f"SELECT id, n::INT AS nodes, {_ENDS} FROM {_lines_sql(_ROADS, _NODES)}",
    "opl_round_trip": f"""SELECT kind, id, version, visible, uid, array_to_string([e.key || '=' || coalesce(e.value, '') FOR e IN list_sort(map_entries(coalesce(tags, MAP {{}})))], '|') AS tags, x, y,
      array_to_string([v FOR v IN coalesce(nodes, []) IF v IS NOT NULL], ',') AS nodes FROM ({_ALL_OBJECTS})""",
    "status_table": """SELECT part, s::INT AS sequence, epoch_us(t) AS micros FROM (SELECT part, max(sequence) FILTER (WHERE state = 'ok') AS s,
      arg_max(date, sequence) FILTER (WHERE state = 'ok' AND sequence IS NOT NULL) AS t FROM status WHERE part IS NOT NULL GROUP BY part)""",
    "node_functions": f"""SELECT id, '12/' || {_PIECE.format('tx')} || '/' || {_PIECE.format('ty')} || '.png' AS path, tx >> 4 AS above, round(pow(x - floor(x), 2) + pow(y - floor(y), 2), 9) AS apart
      FROM (SELECT id, x, y, {_TX} AS tx, {_TY} AS ty FROM {_NODES} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -85 AND 85 AND NOT (x = 0 AND y = 0))""",
}
