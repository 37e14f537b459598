"""Queries of the general data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.model import current_rows, current_values, read
from wayloom.operators import forest, increment, nested, orphans, proximity, widen
from wayloom.session import fresh_folder


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways, relations = (read(spark, d, t) for t in ("nodes", "ways", "relations"))
    refs = orphans.way_references(current_rows(ways, ["nodes", "visible", "date"]).where("visible")).unionByName(
        orphans.member_references(current_rows(relations, ["members", "visible", "date"]).where("visible"))
    )
    parents = [orphans.parent_rows(df, kind) for df, kind in ((nodes, "N"), (ways, "W"), (relations, "R"))]
    return orphans.orphan_references(refs, parents)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = current_values(read(spark, d, "nodes"), ["x", "y", "visible"]).where("visible")
    return proximity.near_pairs(nodes, 10.0)


def p3_places(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found without the pairs of crowds: (kind, a, b) with kind pair for two places that are near, each under its least node, and
    kind member for a place with several nodes and each of them."""
    nodes = current_values(read(spark, d, "nodes"), ["x", "y", "visible"]).where("visible")
    pairs, members = proximity.near_places(nodes, 10.0)
    pairs = pairs.select(F.lit("pair").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(members.select(F.lit("member").alias("kind"), F.col("place").alias("a"), F.col("id").alias("b")))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """(way, node): the current nodes within the ring of each current way that ends where it begins, of the nodes of it that have a place."""
    nodes = proximity.usable_places(current_values(read(spark, d, "nodes"), ["x", "y", "visible"]).where("visible")).select("id", "x", "y")
    ways = current_rows(read(spark, d, "ways"), ["nodes", "visible"]).where("visible")
    closed = ways.where((F.size("nodes") > 3) & (F.element_at("nodes", 1) == F.element_at("nodes", -1)))
    corners = closed.select(F.col("id").alias("way"), F.posexplode("nodes").alias("place", "id")).join(nodes, "id")
    rings = corners.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("ring"))
    found = proximity.points_in_regions(nodes, rings.select(F.col("way").alias("id"), "ring"))
    return found.select(F.col("region").alias("way"), F.col("point").alias("node"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The payloads are visited once; the flat tables are read from what that wrote, one folder a tag."""
    folder = fresh_folder(spark, "nested")
    nested.write_tagged(nested.emit_tagged(read(spark, d, "relation_json")), folder)
    return nested.named_parts(*(nested.read_tagged(spark, folder, tag) for tag in (nested.MEMBER, nested.TAG)))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of all relation rows as a flat table; the schema is known, so no visitor is needed."""
    return (
        read(spark, d, "relations")
        .select("id", "version", "sequence", F.posexplode("members").alias("place", "m"))
        .where(F.col("m").isNotNull())
        .select("id", "version", "sequence", "place", F.upper("m.type").alias("type"), F.col("m.id").alias("ref"), "m.role")
    )


def p2_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation, member and tag rows of all relation rows, through the same visitor as the nested records.

    fields holds the version. Columns that a row's tag does not have are null.
    """
    member = lambda m: F.when(m.isNotNull(), F.struct(m["type"].alias("type"), m["id"].alias("ref"), m["role"].alias("role")))
    record = F.struct("id", "version", "tags", F.transform("members", member).alias("members"))
    payload = F.to_json(record, {"ignoreNullFields": "false"})
    emitted = nested.emit_tagged(read(spark, d, "relations").select(F.col("id").alias("record_id"), "sequence", payload.alias("payload")))
    columns = F.from_json("payload", ", ".join(nested.SCHEMAS.values()))
    return emitted.withColumn("payload", columns).select("record_id", "sequence", "tag", "key", "parent", "place", "payload.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = {k: read(spark, d, f"{k}_changeset") for k in ("node", "way", "relation")}
    return increment.pending_changes(feeds, read(spark, d, "status"), fresh_folder(spark, "increments"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return forest.relation_links(current_rows(read(spark, d, "relations"), ["members", "visible"]).where("visible"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.hierarchies(_links(spark, d))


def tag_types(spark: SparkSession, d: str) -> dict[str, str]:
    """The column types, all of them: they make up the schema of the result."""
    rows = read(spark, d, "tag_types").where("tag_key IS NOT NULL AND col_type IS NOT NULL").collect()
    return {r.tag_key: r.col_type for r in rows}


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for obj, table in (("node", "nodes"), ("way", "ways"), ("relation", "relations")):
        one = current_rows(read(spark, d, table), ["tags", "visible"]).where("visible")
        one = one.select(F.lit(obj).alias("obj"), "id", "tags")
        out = one if out is None else out.unionByName(one)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    types = {k: t for k, t in tag_types(spark, d).items() if t != "text"}
    return widen.unclean_cells(widen.widen(_tagged(spark, d), ["obj", "id"], "tags", types), ["obj", "id"])


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    return _listed(widen.widen(_tagged(spark, d), ["obj", "id"], "tags", tag_types(spark, d)))


def p7_entries(spark: SparkSession, d: str) -> DataFrame:
    """The wide table from rows of entity, attribute and value; objects without tags have no row here."""
    rows = _tagged(spark, d).select("obj", "id", F.explode("tags").alias("attribute", "value"))
    return _listed(widen.widen_entries(rows, ["obj", "id"], "attribute", "value", tag_types(spark, d)))


def _listed(wide: DataFrame) -> DataFrame:
    """The lists of attributes as sorted text."""
    return wide.withColumns({c: F.array_join(F.sort_array(c), ",") for c in ("bad", "conflict", "unfit")})


def current_sql(table: str, columns: str) -> str:
    return (
        f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, sequence DESC) "
        f"AS rn FROM {table}) WHERE rn = 1 AND visible)"
    )


_REFS = f"""
  SELECT DISTINCT 'ways' AS src, id AS src_id, date, 'N' AS ref_type, ref_id
  FROM (SELECT id, date, unnest(nodes) AS ref_id FROM {current_sql("ways", "id, date, nodes")})
  WHERE ref_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'relations', id, date, upper(m.type), m.id
  FROM (SELECT id, date, unnest(members) AS m FROM {current_sql("relations", "id, date, members")})
  WHERE m.id IS NOT NULL AND upper(m.type) IN ('N', 'W', 'R')"""
_TARGETS = " UNION ALL ".join(
    f"SELECT '{k}' AS ref_type, id AS ref_id, arg_max(visible, version) AS visible, "
    f"min(date) FILTER (WHERE version = 1) AS first FROM {t} GROUP BY id"
    for k, t in (("N", "nodes"), ("W", "ways"), ("R", "relations"))
)
_P1 = f"""
WITH refs AS ({_REFS}), targets AS ({_TARGETS}), joined AS (
  SELECT r.*, CASE WHEN t.ref_id IS NULL THEN 'missing' WHEN NOT t.visible THEN 'deleted'
    WHEN t.first > r.date THEN 'late' END AS state
  FROM refs r LEFT JOIN targets t ON t.ref_type = r.ref_type AND t.ref_id = r.ref_id)
SELECT src, src_id, ref_type, ref_id, state, coalesce(strftime(timezone('UTC', date), '%Y-%m'), 'none') AS period
FROM joined WHERE state IS NOT NULL"""

_P3 = f"""
WITH p AS (SELECT id, x, y, floor(y / 0.0001)::BIGINT AS r FROM {current_sql("nodes", "id, x, y")}
  WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND NOT (x = 0 AND y = 0)),
q AS (SELECT *, r + unnest([-1, 0, 1]) AS k FROM p)
SELECT a.id AS node_a, b.id AS node_b FROM q a JOIN p b ON a.k = b.r AND a.id < b.id
WHERE pow(sin(radians(b.y - a.y) / 2), 2)
  + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)
  <= pow(sin(10 / 6371008.8 / 2), 2)"""

_P3_PLACES = f"""
WITH found AS ({_P3}), n AS (SELECT id, x, y FROM {current_sql("nodes", "id, x, y")} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND NOT (x = 0 AND y = 0)),
place AS (SELECT id, min(id) OVER (PARTITION BY x, y) AS place, count(*) OVER (PARTITION BY x, y) AS many FROM n)
SELECT 'pair' AS kind, node_a AS a, node_b AS b FROM found JOIN place p ON p.id = node_a AND p.place = node_a JOIN place q ON q.id = node_b AND q.place = node_b
UNION ALL SELECT 'member', place, id FROM place WHERE many > 1"""

_P3_REGIONS = f"""
WITH p AS (SELECT id, x, y FROM {current_sql("nodes", "id, x, y")} WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND NOT (x = 0 AND y = 0)),
closed AS (SELECT id, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS place FROM {current_sql("ways", "id, nodes")} WHERE len(nodes) > 3 AND nodes[1] = nodes[-1]),
corners AS (SELECT c.id, c.place, p.x, p.y, count(*) OVER (PARTITION BY c.id) AS n FROM closed c JOIN p ON p.id = c.node),
edges AS (SELECT id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM corners WHERE n > 2 WINDOW w AS (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
boxes AS (SELECT id, min(x1) AS a, max(x1) AS b, min(y1) AS c, max(y1) AS d FROM edges GROUP BY id),
near AS (SELECT b.id AS way, p.id AS node, p.x, p.y FROM boxes b JOIN p ON p.y BETWEEN b.c AND b.d AND p.x BETWEEN b.a AND b.b)
SELECT way, node FROM near JOIN edges e ON e.id = way
GROUP BY way, node HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1"""

_P5 = """
WITH feed AS (
  SELECT 'node' AS feed, id, version, sequence, date FROM node_changeset
  UNION ALL SELECT 'way', id, version, sequence, date FROM way_changeset
  UNION ALL SELECT 'relation', id, version, sequence, date FROM relation_changeset),
marks AS (SELECT part, max(sequence) FILTER (WHERE state = 'ok') AS s,
  arg_max(date, sequence) FILTER (WHERE state = 'ok' AND sequence IS NOT NULL) AS t FROM status WHERE part IS NOT NULL GROUP BY part)
SELECT part, feed, id, version FROM feed, marks GROUP BY ALL
HAVING NOT coalesce(bool_or(coalesce(sequence <= s AND date <= t, false)), false)"""

_P6 = f"""
WITH RECURSIVE rel AS {current_sql("relations", "id, members")},
links AS (SELECT DISTINCT r.id AS p, r.m.id AS c FROM (SELECT id, unnest(members) AS m FROM rel) r
  WHERE upper(r.m.type) = 'R' AND r.m.id <> r.id AND r.m.id IN (SELECT id FROM rel)),
walk AS (
  SELECT DISTINCT p AS id, p AS root, [p] AS path FROM links WHERE p NOT IN (SELECT c FROM links)
  UNION ALL SELECT l.c, w.root, list_append(w.path, l.c) FROM walk w JOIN links l ON l.p = w.id WHERE NOT list_contains(w.path, l.c)),
reach AS (SELECT p AS a, c AS b FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.b),
cyclic AS (SELECT a AS id FROM reach WHERE a = b)
SELECT 'path' AS kind, id, root, len(path)::INT AS depth, array_to_string(path, '/') AS path FROM walk
UNION ALL
SELECT 'cycle', c.id, (SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = c.id), 0, '' FROM cyclic c"""

_TAGGED = " UNION ALL ".join(
    f"SELECT '{o}' AS obj, id, unnest(map_entries(tags)) AS e FROM {current_sql(t, 'id, tags')}"
    for o, t in (("node", "nodes"), ("way", "ways"), ("relation", "relations"))
)
_P7 = f"""
WITH e AS (SELECT obj, id, lower(trim(e.key, ' ')) AS tag_key, trim(e.value, ' ') AS v FROM ({_TAGGED}) WHERE e.value IS NOT NULL),
typed AS (SELECT e.*, t.col_type AS k FROM e JOIN tag_types t USING (tag_key) WHERE t.col_type <> 'text' AND v <> ''),
parsed AS (SELECT *, CASE
  WHEN k = 'int' AND regexp_full_match(v, '[+-]?[0-9]+') THEN v::HUGEINT::VARCHAR
  WHEN k = 'double' AND regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') THEN (v::DOUBLE + 0)::VARCHAR
  WHEN k = 'bool' AND lower(v) IN ('yes', 'true', '1') THEN 't'
  WHEN k = 'bool' AND lower(v) IN ('no', 'false', '0') THEN 'f'
  WHEN k = 'date' AND regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(v AS DATE)::VARCHAR END AS r FROM typed)
SELECT obj, id, tag_key, 'bad' AS state FROM parsed WHERE r IS NULL GROUP BY ALL
UNION ALL
SELECT obj, id, tag_key, 'conflict' FROM parsed GROUP BY obj, id, tag_key HAVING count(DISTINCT r) > 1"""

_JSON_NUMBER = """CASE WHEN json_type(n, 'ref') IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN n->>'ref'
  WHEN json_type(n, 'ref') = 'DOUBLE' THEN CASE WHEN (n->>'ref')::DOUBLE = floor((n->>'ref')::DOUBLE) THEN (n->>'ref')::DOUBLE::HUGEINT::VARCHAR ELSE n->>'ref' END
  WHEN json_type(n, 'ref') = 'VARCHAR' AND regexp_full_match(trim(n->>'ref'), '[+-]?[0-9]+') THEN trim(n->>'ref')::HUGEINT::VARCHAR ELSE '' END"""
_P2 = f"""
WITH RECURSIVE records AS (SELECT DISTINCT record_id, payload::JSON AS n FROM relation_json WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
nodes AS (
  SELECT record_id, n, '' AS path, 0 AS deep FROM records
  UNION ALL
  SELECT record_id, m, CASE WHEN deep = 0 THEN place::VARCHAR ELSE path || '.' || place END, deep + 1 FROM (
    SELECT record_id, path, deep, unnest(list) AS m, generate_subscripts(list, 1) - 1 AS place FROM (
      SELECT record_id, path, deep, CASE json_type(n, 'members') WHEN 'OBJECT' THEN [n->'members'] WHEN 'ARRAY' THEN (n->'members')::JSON[] END AS list FROM nodes))
  WHERE json_type(m) = 'OBJECT'),
entries AS (
  SELECT record_id, path, k AS name, n->'tags'->k AS v FROM (SELECT *, unnest(json_keys(n, 'tags')) AS k FROM nodes WHERE json_type(n, 'tags') = 'OBJECT')
  UNION ALL
  SELECT record_id, path, e->>'k', e->'v' FROM (SELECT record_id, path, unnest((n->'tags')::JSON[]) AS e FROM nodes WHERE json_type(n, 'tags') = 'ARRAY')
  WHERE json_type(e) = 'OBJECT' AND json_type(e, 'k') = 'VARCHAR'),
flat AS (
  SELECT * FROM entries
  UNION ALL
  SELECT record_id, path, name || ':' || k, v->k FROM (SELECT *, unnest(json_keys(v)) AS k FROM flat WHERE json_type(v) = 'OBJECT'))
SELECT DISTINCT record_id, path, 'tag' AS kind, name FROM flat WHERE json_type(v) IS DISTINCT FROM 'OBJECT'
UNION
SELECT record_id, path, 'member', CASE WHEN json_type(n, 'type') = 'VARCHAR' THEN upper(left(trim(n->>'type'), 1)) ELSE '' END || {_JSON_NUMBER} FROM nodes WHERE deep > 0"""
_P2_RELATIONS = """
SELECT id AS record_id, sequence, 'relation' AS tag, '' AS key, NULL::VARCHAR AS parent, NULL::INT AS place, coalesce(id::VARCHAR, '') AS id,
  '{"version": ' || coalesce(version::VARCHAR, 'null') || '}' AS fields, NULL::VARCHAR AS type, NULL::VARCHAR AS ref, NULL::VARCHAR AS role, NULL::VARCHAR AS name, NULL::VARCHAR AS value FROM relations
UNION ALL
SELECT id, sequence, 'member', place::VARCHAR, '', place, NULL, NULL, coalesce(upper(left(trim(m.type), 1)), ''), coalesce(m.id::VARCHAR, ''), m.role, NULL, NULL
FROM (SELECT id, sequence, unnest(members) AS m, (generate_subscripts(members, 1) - 1)::INT AS place FROM relations) WHERE m IS NOT NULL
UNION ALL
SELECT id, sequence, 'tag', '', '', place, NULL, NULL, NULL, NULL, NULL, e.key, e.value
FROM (SELECT id, sequence, unnest(map_entries(tags)) AS e, (generate_subscripts(map_keys(tags), 1) - 1)::INT AS place FROM relations)"""
_BIG = "regexp_replace(regexp_replace(v, '^[+]', ''), '^(-?)0+([0-9])', '\\1\\2')"
_READ = f"""CASE
  WHEN k = 'int' AND regexp_full_match(v, '[+-]?[0-9]+') THEN CASE WHEN {_BIG} = '-0' THEN '0' ELSE {_BIG} END
  WHEN k = 'double' AND regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') THEN (v::DOUBLE + 0)::VARCHAR
  WHEN k = 'bool' AND lower(v) IN ('yes', 'true', '1') THEN 'true'
  WHEN k = 'bool' AND lower(v) IN ('no', 'false', '0') THEN 'false'
  WHEN k = 'date' AND regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(v AS DATE)::VARCHAR
  WHEN k = 'text' THEN v END"""


def _wide_sql(types: dict[str, str], rows: str) -> str:
    """The wide table: a column for each attribute, null where the cell could not be filled cleanly."""
    sql = {"int": "BIGINT", "double": "DOUBLE", "bool": "BOOLEAN", "date": "DATE", "text": "VARCHAR"}
    cells = ", ".join(f"try_cast(max(r) FILTER (WHERE tag_key = '{k}' AND clean) AS {sql[t]}) AS \"{k}\"" for k, t in types.items())
    names = lambda flag: f"coalesce(string_agg(tag_key, ',' ORDER BY tag_key) FILTER (WHERE {flag}), '')"
    return f"""
WITH e AS (SELECT obj, id, lower(trim(e.key, ' ')) AS tag_key, trim(e.value, ' ') AS v FROM ({_TAGGED}) WHERE e.value IS NOT NULL),
parsed AS (SELECT obj, id, tag_key, k, {_READ} AS r FROM (SELECT e.*, t.col_type AS k FROM e JOIN tag_types t USING (tag_key) WHERE v <> '')),
cells AS (SELECT obj, id, tag_key, k, min(r) AS r, bool_or(r IS NULL) AS bad, count(DISTINCT r) > 1 AS conflict FROM parsed GROUP BY ALL),
marked AS (SELECT *, NOT bad AND NOT conflict AS clean, NOT bad AND NOT conflict AND k = 'int' AND try_cast(r AS BIGINT) IS NULL AS unfit FROM cells),
wide AS (SELECT obj, id, {cells}, {names('bad')} AS bad, {names('conflict')} AS conflict, {names('unfit')} AS unfit FROM marked GROUP BY obj, id)
SELECT * EXCLUDE (bad, conflict, unfit), coalesce(bad, '') AS bad, coalesce(conflict, '') AS conflict, coalesce(unfit, '') AS unfit FROM ({rows}) LEFT JOIN wide USING (obj, id)"""


# The attributes of the test tables and their types, in the order of the table
TYPES = {
    "lanes": "int", "maxspeed": "int", "capacity": "int", "population": "int", "layer": "int", "ele": "double", "width": "double",
    "distance": "double", "ascent": "double", "height": "double", "oneway": "bool", "lit": "bool", "bridge": "bool", "wheelchair": "bool",
    "roundtrip": "bool", "start_date": "date", "check_date": "date", "survey:date": "date", "name": "text", "ref": "text",
    "operator": "text", "surface": "text", "cuisine": "text", "network": "text",
}
_OBJECTS = " UNION ALL ".join(f"SELECT '{o}' AS obj, id FROM {current_sql(t, 'id, tags')}" for o, t in (("node", "nodes"), ("way", "ways"), ("relation", "relations")))

QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_members": p2_members, "p2_relations": p2_relations, "p3_found": p3_found, "p3_regions": p3_regions, "p3_places": p3_places,
    "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_wide": p7_wide, "p7_entries": p7_entries,
}
ORACLES = {
    "p1_found": _P1,
    "p1_report": f"SELECT src, period, ref_type, state, count(*) AS refs, count(DISTINCT ref_id) AS keys FROM ({_P1}) GROUP BY ALL",
    "p2_members": "SELECT id, version, sequence, place, upper(m.type) AS type, m.id AS ref, m.role AS role FROM (SELECT id, version, "
    "sequence, unnest(members) AS m, (generate_subscripts(members, 1) - 1)::INT AS place FROM relations) WHERE m IS NOT NULL",
    "p2_found": _P2,
    "p2_relations": _P2_RELATIONS,
    "p3_found": _P3,
    "p3_regions": _P3_REGIONS,
    "p3_places": _P3_PLACES,
    "p5_found": _P5,
    "p6_found": _P6,
    "p7_found": _P7,
    "p7_wide": _wide_sql(TYPES, _OBJECTS),
    "p7_entries": _wide_sql(TYPES, f"SELECT DISTINCT obj, id FROM ({_TAGGED})"),
}
