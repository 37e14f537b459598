import math
import random

import pytest
from pyspark.sql import functions as F

from tests.build import changes, grid, nodes, relations, rows, ways
from wayloom.functions import geo, tags, tiles
from wayloom.model import Source
from wayloom.operators import relational as rel
from wayloom.operators.route import nested_route_lines, route_lines, stitch
from wayloom.operators.tiling import apply_plan, fill_tiles, find_tiles, plan_tiles, touched_tiles, write_tiles
from wayloom.sources.snapshot import NoStatus, StatusManager


def one(spark, values, expr):
    """The value of an expression over a tag map."""
    return spark.createDataFrame([(values,)], "t map<string,string>").select(expr(F.col("t")).alias("r")).collect()[0].r


@pytest.mark.parametrize("keys, default, want", [(("one", "two"), None, "foo"), (("two", "one"), None, "bar"), (("three", "two"), None, "bar"), (("x",), "baz", "baz"), (("x",), None, None)])
def test_first_of(spark, keys, default, want):
    assert one(spark, {"one": "foo", "two": "bar"}, lambda t: tags.first_of(t, *keys, default=default)) == want


def test_prefix_and_booleans(spark):
    assert one(spark, {"name:de": "a", "name": "b", "x": "c"}, lambda t: tags.with_prefix(t, "name:")) == {"de": "a"}
    assert one(spark, {"a": "true", "b": "True", "c": "no", "d": "noo", "e": "yes", "f": "false"}, tags.booleans) == {"a": True, "b": True, "c": False, "e": True, "f": False}


@pytest.mark.parametrize(
    "given, locales, want",
    [
        ({"name": "a", "name:de": "b", "name:en": "c"}, ["de", "en"], {"name": "b"}),
        ({"name": "a", "name:de": "b", "name:en": "c"}, ["en"], {"name": "c", "name:de": "b"}),
        ({"name:de": "b", "ref": "1"}, ["de"], {"name": "b", "ref": "1"}),
        ({"name:de:x": "b"}, ["de"], {"name:de:x": "b"}),
        ({"name": "a"}, [], {"name": "a"}),
        ({}, ["de"], {}),
    ],
)
def test_localized(spark, given, locales, want):
    assert one(spark, given, lambda t: tags.localized(t, locales)) == want


@pytest.mark.parametrize(
    "given, url, pages",
    [
        ({"wikipedia": "Something"}, "https://en.wikipedia.org/wiki/Something", {"en": "Something"}),
        ({"wikipedia": "de:Etw as"}, "https://de.wikipedia.org/wiki/Etw%20as", {"de": "Etw as"}),
        ({"wikipedia:est": "Nada/x*y~z"}, "https://est.wikipedia.org/wiki/Nada/x%2Ay~z", {"est": "Nada/x*y~z"}),
        ({"wikipedia:hun": "Nada", "wikipedia": "de:Nichts"}, "https://de.wikipedia.org/wiki/Nichts", {"hun": "Nada", "de": "Nichts"}),
        ({"wikipedia": "ab"}, "https://en.wikipedia.org/wiki/ab", {"en": "ab"}),
        ({"name": "wikipedia"}, None, {}),
        ({"wikipedia": "http://en.wikipedia.org/wiki/S"}, None, {}),
        ({"wikipedia": "xxxx:Entry"}, None, {}),
        ({"wikipedia:x": "Nada"}, None, {}),
        ({"wikipedia:1234": "Nada"}, None, {}),
    ],
)
def test_wikipedia(spark, given, url, pages):
    assert one(spark, given, tags.wikipedia_url) == url
    assert one(spark, given, tags.wikipedia_pages) == pages


@pytest.mark.parametrize(
    "given, want",
    [
        ({"url": "http://foo.bar", "website": "https://foo.bar"}, "http://foo.bar"),
        ({"website": "HTTPS://a.b/c?d"}, "HTTPS://a.b/c?d"),
        ({"url": "http://a.b/\"x'"}, "http://a.b/%22x%27"),
        ({"url": "ftp://a.b"}, None),
        ({"url": "foo.bar"}, None),
        ({"url": "http://"}, None),
        ({}, None),
    ],
)
def test_url(spark, given, want):
    assert one(spark, given, tags.url) == want


@pytest.mark.parametrize(
    "value, unit, default, want",
    [
        ("10", "km", "km", 10.0), ("10.5 m", "km", "km", 0.0105), ("1,5 km", "m", "km", 1500.0), ("20 MI", "km", "km", 32.186), ("6'", "ft", "km", 6.0),
        (" 7ft tall", "m", "km", 7 * 0.3048), ("5 yards", "km", "km", None), ("about 5", "km", "km", None), ("5", "m", "ft", 5 * 0.3048), ("", "km", "km", None),
    ],
)
def test_length(spark, value, unit, default, want):
    got = one(spark, {"len": value}, lambda t: tags.length(t, "len", unit=unit, default=default))
    assert got is None and want is None or got == pytest.approx(want)


def test_length_of_unknown_unit():
    with pytest.raises(ValueError):
        tags.length(F.lit(None), "x", unit="parsec")


def test_points(spark):
    n = nodes(spark, (1, 10, 3), (2, -68, 12))
    hexes = rows(n.select(geo.ewkb_point(F.col("x"), F.col("y"), 3875).alias("h"), "id"), "id", "h")
    assert hexes == [(1, "0101000020230f000000000000000024400000000000000840"), (2, "0101000020230f000000000000000051c00000000000002840")]
    back = n.select(geo.point_of_ewkb(F.unhex(geo.ewkb_point(F.col("x"), F.col("y")))).alias("p")).select("p.*")
    assert rows(back, "x", "y") == [(-68.0, 12.0), (10.0, 3.0)]
    m = nodes(spark, (1, 20.2, 45.5)).select(geo.mercator_x(F.col("x")).alias("x"), geo.mercator_y(F.col("y")).alias("y")).collect()[0]
    assert (m.x, m.y) == (pytest.approx(2248653.7140241), pytest.approx(5700582.7324697))


def test_tiles(spark):
    t = spark.createDataFrame([(0, 0, 0), (3, 4, 2), (12, 1234, 56), (12, 7, 4000)], "z int, x int, y int")
    box = tiles.tile_box(F.col("z"), F.col("x"), F.col("y"))
    got = t.select(tiles.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id"), box["x0"].alias("x0"), box["y0"].alias("y0"), box["y1"].alias("y1"),
                   tiles.tile_path(F.col("z"), F.col("x"), F.col("y"), True).alias("path")).collect()
    w = tiles.HALF_WORLD
    assert [r.id for r in got] == [0, 3 + (4 << 5) + (2 << 8), 12 + (1234 << 5) + (56 << 17), 12 + (7 << 5) + (4000 << 17)]
    assert (got[0].x0, got[0].y0, got[0].y1) == (-w, -w, w) and (got[1].x0, got[1].y1) == (0, pytest.approx(w / 2))
    assert [r.path for r in got] == ["0/0/0.png", "3/4/2.png", "12/123/4/56/o.png", "12/7/o/400/0.png"]


def line(spark, *lines):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in pts]) for i, pts in enumerate(lines)], "id bigint, geom array<struct<x:double,y:double>>")


def test_tile_plan(spark):
    w = tiles.HALF_WORLD
    data = line(spark, [(-w + 1, w - 1), (-w + 2, w - 2)])
    change = data.unionByName(line(spark, [(w - 1, 1 - w), (w - 2, 2 - w)]))
    got = rows(plan_tiles(data, change, 0, 2, 1), "zoom", "x", "y", "task")
    assert got == [(0, 0, 0, "render"), (1, 0, 0, "render"), (1, 1, 1, "delete"), (2, 0, 0, "reserve"), (2, 3, 3, "delete")]
    assert rows(plan_tiles(data, None, 0, 1, 1), "zoom", "task") == [(0, "render"), (1, "render")]
    diagonal = rows(touched_tiles(line(spark, [(1 - w, w / 2 + 10), (-w / 2 + 10, 1)]), 1, 2), "zoom", "x", "y")
    assert diagonal == [(1, 0, 0), (2, 0, 0), (2, 0, 1), (2, 1, 1)] or (2, 0, 0) in diagonal
    store = spark.createDataFrame([(0, b"old"), (33 + 256 * 0, b"gone")], "id bigint, pixbuf binary")
    plan = spark.createDataFrame([(0, "render"), (33, "delete"), (2, "reserve")], "id bigint, task string")
    rendered = spark.createDataFrame([(0, b"new")], "id bigint, pixbuf binary")
    assert {r.id: r.pixbuf and bytes(r.pixbuf) for r in apply_plan(store, plan, rendered).collect()} == {0: b"new", 2: None}


def test_tile_plan_of_a_batch(spark, tmp_path):
    """Way 1 moves through a node alone, 2 is deleted, 3 stays, 4 is new; no other tile has lines afterwards."""
    from wayloom.plans import derived

    spots = {1: (-170, 80), 2: (-169.9, 80), 3: (-100, -70), 4: (-99.9, -70), 5: (10, 10), 6: (10.1, 10), 7: (100, 20), 8: (100.1, 20)}
    n = [(i, None, float(x), float(y), True, 1, 1) for i, (x, y) in spots.items()]
    n += [(1, None, 100.0, -60.0, True, 2, derived.BEFORE), (2, None, 100.1, -60.0, True, 2, derived.BEFORE)]
    w = [(1, None, [1, 2], True, 1, 1), (2, None, [3, 4], True, 1, 1), (2, None, [3, 4], False, 2, derived.BEFORE), (3, None, [5, 6], True, 1, 1), (4, None, [7, 8], True, 1, derived.BEFORE)]
    end = "visible boolean, version int, sequence int"
    spark.createDataFrame(n, f"id bigint, tags map<string,string>, x double, y double, {end}").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame(w, f"id bigint, tags map<string,string>, nodes array<bigint>, {end}").write.parquet(f"{tmp_path}/ways.parquet")
    got = {(r.zoom, r.x, r.y): r.task for r in derived.tile_plan(spark, str(tmp_path)).collect()}

    def tile(x, y, zoom=8):
        row = nodes(spark, (1, x, y)).select(tiles.tile_column(geo.mercator_x(F.col("x")), F.lit(zoom)).alias("x"), tiles.tile_row(geo.mercator_y(F.col("y")), F.lit(zoom)).alias("y")).first()
        return zoom, row.x, row.y

    assert got[tile(-170, 80)] == got[tile(-100, -70)] == got[tile(-170, 80, 3)] == "delete"
    assert got[tile(100, -60)] == got[tile(100, 20)] == "reserve" and got[tile(100, -60, 5)] == got[0, 0, 0] == "render" and tile(10, 10) not in got


def parts(text):
    return [[(0.0, float(p)) for p in part.split(",")] for part in text.split()]


@pytest.mark.parametrize(
    "members, want",
    [
        ("1,2,3", "1,2,3"), ("1,2|2,3", "1,2,3"), ("2,1|2,3", "1,2,3"), ("1,2|3,2", "1,2,3"), ("2,1|3,2", "1,2,3"),
        ("1,2|3,4", "1,2 3,4"), ("1,2|4,3", "1,2 3,4"), ("2,1|3,4", "1,2 3,4"), ("2,1|4,3", "1,2 3,4"),
        ("1,2|4,3|3,5", "1,2 4,3,5"), ("1,2|3,4|3,5", "1,2 4,3,5"), ("1,2|4,3|5,3", "1,2 4,3,5"), ("1,2|3,4|5,3", "1,2 4,3,5"),
        ("2,1|2,3|3,4", "1,2,3,4"), ("2,1|3,2|3,4", "1,2,3,4"), ("3,4 1,2", "3,4 1,2"),
        ("1,2 3,4|4,5 7,8", "1,2 3,4,5 7,8"), ("1,2 3,4|8,7 5,4", "1,2 3,4,5 7,8"), ("4,3 2,1|4,5 7,8", "1,2 3,4,5 7,8"), ("4,3 2,1|8,7 5,4", "1,2 3,4,5 7,8"),
        ("1,2 3,4|5,6 7,8", "1,2 3,4 5,6 7,8"), ("1,2 3,4|8,7 6,5", "1,2 3,4 5,6 7,8"), ("4,3 2,1|5,6 7,8", "1,2 3,4 5,6 7,8"), ("4,3 2,1|8,7 6,5", "1,2 3,4 5,6 7,8"),
    ],
)
def test_stitch(members, want):
    pieces = {i: parts(m) for i, m in enumerate(members.split("|"))}
    assert stitch(list(pieces), pieces) == parts(want)


def test_stitch_takes_a_piece_again():
    pieces = {1: parts("1,2"), 2: parts("2,3,4"), 3: parts("2,5,4")}
    assert stitch([1, 2, 3, 1, 9], pieces) == parts("1,2,3,4,5,2,1") and stitch([], {}) == []


def test_routes(spark):
    w = line(spark, [(0, 0), (1, 1)], [(2, 2), (1, 1)]).unionByName(line(spark, [(9, 9), (8, 8)]).withColumn("id", F.lit(2).cast("bigint")))
    r = relations(spark, {1: "w0 n7 w1 w99", 2: "n1", 3: "w2 r1"})
    first = route_lines(r, w)
    got = {x.id: [[p.x for p in part] for part in x.lines] for x in first.collect()}
    assert got[1] == [[0, 1, 2]] and 2 not in got
    nested = {x.id: [[p.x for p in part] for part in x.lines] for x in route_lines(r.where("id = 3"), w, first.where("id = 1")).collect()}
    assert nested[3] == [[9, 8], [2, 1, 0]]


@pytest.mark.parametrize("task_refs", [0, 3, 1000])
def test_routes_of_routes(spark, task_refs):
    w = line(spark, *([(i, 0), (i + 1, 0)] for i in range(6)))
    spec = {1: "w0 r2 r2 r77", 2: "r3 r2", 3: "w1 w2", 4: "n1 r1 w3", 5: "r6 w4", 6: "w5 r7", 7: "r5 r6 w3", 8: "r5", 9: "n9 r99"}
    got = {x.id: [[p.x for p in part] for part in x.lines] for x in nested_route_lines(relations(spark, spec), w, task_refs).collect()}
    assert got[2] == got[3] == [[1, 2, 3]] and got[1] == [[0, 1, 2, 3, 2, 1]] and 9 not in got
    assert got[4][0][:4] == [0, 1, 2, 3] and set(got) == set(range(1, 9))
    assert all({p for part in got[i] for p in part} == {3, 4, 5, 6} for i in (5, 6, 7, 8)) and got[8] == got[5]


def test_routes_in_tasks_and_in_rounds_are_the_same(spark):
    rng = random.Random(5)
    w = line(spark, *([(rng.randrange(4), rng.randrange(4)), (rng.randrange(4), rng.randrange(4))] for _ in range(12)))
    spec = {i: " ".join(rng.choice(["w", "w", "r", "n"]) + str(rng.randrange(12)) for _ in range(rng.randrange(1, 6))) for i in range(1, 40)}
    spec |= {100 + i: f"r{101 + i} w{i % 12}" for i in range(30)}
    both = [rows(nested_route_lines(relations(spark, spec), w, n), "id", "lines") for n in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) > 60


def test_points_of_all_sorts_of_wkb(spark):
    import struct

    little, big = struct.pack("<BIIdd", 1, 0x20000001, 4326, 1.5, -2.0), struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    line_ = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    blobs = [little, None, b"", b"\x01", big, little[:-1], struct.pack("<BIdd", 1, 1, 5.0, 6.0), line_, little]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, geom binary").coalesce(1)
    got = {r.id: (r.p.x, r.p.y) if r.p else None for r in df.select("id", geo.point_of_ewkb(F.col("geom")).alias("p")).collect()}
    none = (None, None)
    assert [got[i] or none for i in range(9)] == [(1.5, -2.0), none, none, none, (3.0, 4.0), none, (5.0, 6.0), none, (1.5, -2.0)]
    assert df.limit(0).select(geo.point_of_ewkb(F.col("geom"))).count() == 0


def test_tile_store_look_up_and_files(spark, tmp_path):
    ids = lambda z, x, y: z + (x << 5) + (y << (5 + z))
    store = spark.createDataFrame([(ids(2, 1, 3), b"p"), (ids(2, 0, 0), None)], "id bigint, pixbuf binary")
    asked = [(2, 1, 3, "a"), (2, 0, 0, "b"), (2, 3, 3, "c"), (4, 5, 13, "d"), (4, 2, 2, "e"), (4, 15, 15, "f"), (0, 0, 0, "g")]
    got = find_tiles(store, spark.createDataFrame(asked, "zoom int, x bigint, y bigint, state0 string"), 2)
    assert {r.state0: (r.state, bytes(r.pixbuf) if r.pixbuf else None) for r in got.collect()} == {
        "a": ("stored", b"p"), "b": ("render", None), "c": ("empty", None), "d": ("render", None), "e": ("render", None), "f": ("empty", None), "g": ("empty", None),
    }
    new = spark.createDataFrame([(ids(2, 1, 3), b"q"), (ids(2, 0, 0), b"r"), (99, b"s")], "id bigint, pixbuf binary")
    assert {r.id: bytes(r.pixbuf) for r in fill_tiles(store, new).collect()} == {ids(2, 1, 3): b"p", ids(2, 0, 0): b"r"}
    pictures = spark.createDataFrame([(2, 1, 3, b"p"), (12, 1234, 56, None)], "zoom int, x bigint, y bigint, pixbuf binary")
    paths = sorted(r.path for r in write_tiles(pictures, f"file://{tmp_path}/tiles").collect())
    assert paths == ["12/123/4/56/o.png", "2/1/3.png"]
    assert [(tmp_path / "tiles" / p).read_bytes() for p in paths] == [b"", b"p"]


@pytest.mark.parametrize("seed", range(2))
def test_touched_tiles_against_all_tiles(spark, seed):
    rng, w = random.Random(seed), tiles.HALF_WORLD
    spots = [(rng.uniform(-w, w), rng.uniform(-w, w)) for _ in range(6)] + [(0.0, 5.0), (0.0, 9e6), (-3e6, 5.0)]
    lines = [[rng.choice(spots), rng.choice(spots)] for _ in range(12)]

    def crosses(a, b, box):
        """The part of the stretch within each pair of sides."""
        lo, hi = 0.0, 1.0
        for p, d, s, t in ((a[0], b[0] - a[0], box[0], box[2]), (a[1], b[1] - a[1], box[1], box[3])):
            if d == 0:
                if not s <= p <= t:
                    return False
            else:
                lo, hi = max(lo, min((s - p) / d, (t - p) / d)), min(hi, max((s - p) / d, (t - p) / d))
        return lo <= hi

    size = 2 * w / 16
    want = {(x, y) for a, b in lines for x in range(16) for y in range(16) if crosses(a, b, (x * size - w, w - (y + 1) * size, (x + 1) * size - w, w - y * size))}
    got = rows(touched_tiles(line(spark, *lines), 2, 4), "zoom", "x", "y")
    assert {(x, y) for z, x, y in got if z == 4} == want
    assert {(x, y) for z, x, y in got if z == 2} == {(x >> 2, y >> 2) for x, y in want}


def test_selectors(spark):
    s = Source(grid(spark, 1, 2), changes(spark, "A1", "M2", "D3", "C4"))
    ids = lambda df: [r[0] for r in rows(df, "id")]
    assert ids(rel.modified_or_deleted(s)) == [2, 3, 4] and ids(rel.added_or_modified(s)) == [1, 2, 4]
    assert ids(rel.modified(s)) == [2] and ids(rel.deleted(s)) == [3] and ids(rel.changed(s)) == [1, 2, 3, 4]
    assert ids(rel.modified(Source(s.data))) == [1, 2]
    assert ids(rel.without(s.data, changes(spark, "D1"))) == [2]
    put = nodes(spark, (2, 9, 9), (5, 5, 5))
    assert rows(rel.upsert(s.data, put), "id", "x")[1:] == [(2, 9.0), (5, 5.0)]
    assert ids(rel.holding(ways(spark, {1: [1, 2], 2: [3], 3: []}), "nodes", changes(spark, "M2", "M3"))) == [1, 2]
    many = spark.createDataFrame([(1, "C", 1), (1, "D", 2)], "id bigint, action string, version int")
    assert rows(rel.last_actions(many, "version"), "id", "action") == [(1, "D")]


def test_differences_of_maps_and_nulls(spark):
    schema = "id bigint, tags map<string,string>, x double"
    a = spark.createDataFrame([(1, {"a": "1", "b": "2"}, None), (2, None, 1.0), (3, {}, 1.0)], schema)
    b = spark.createDataFrame([(1, {"b": "2", "a": "1"}, None), (2, {}, 1.0), (3, {}, 1.0)], schema)
    assert rows(rel.difference(a, b), "id", "action") == [(2, "M")]
    assert rel.difference(a, b, ["x"]).count() == 0


def test_status(spark):
    import datetime as dt

    s = StatusManager()
    date = dt.datetime(2024, 5, 6, tzinfo=dt.UTC)
    assert s.get_sequence() is None and s.get_date() is None and s.get_min_sequence() is None
    s.set_status("base", date, 5)
    s.set_status("other", None, 3)
    s.set_status_from("third", "base")
    assert (s.get_sequence("third"), s.get_date("third"), s.get_min_sequence()) == (5, date, 3)
    with pytest.raises(KeyError):
        s.set_status_from("x", "none")
    s.remove_status("other")
    s.remove_status("other")
    assert s.get_min_sequence() == 5 and s.table(spark).count() == 2
    n = NoStatus()
    n.set_status("base", date, 5)
    assert n.get_sequence() is None and n.get_min_sequence() is None


def test_nudge_of_nothing(spark):
    df = spark.createDataFrame([([],), ([(None, 1.0), (2.0, 2.0)],)], "p array<struct<x:double,y:double>>")
    assert sorted(len(r.g) for r in df.select(geo.nudged(F.col("p")).alias("g")).collect()) == [0, 1]
    assert math.isclose(geo.NUDGE, 1e-8)


def test_tag_links_of_all_objects(spark, tmp_path):
    from wayloom.plans import derived

    n = [(11, {"name": None, "wikipedia": "x y"}), (12, None), (15, {"name": "n", "website": None, "wikipedia:de": None}), (16, None), (17, {"url": "ftp://a/b"})]
    columns = {"nodes": "x double, y double", "ways": "nodes array<bigint>", "relations": "members array<struct<id:bigint,role:string,type:string>>"}
    for table, extra in columns.items():
        fill = (None,) * (2 if table == "nodes" else 1)
        spark.createDataFrame([(i, t, *fill, True, 1, 1) for i, t in (n if table == "nodes" else n[1:2])], f"id bigint, tags map<string,string>, {extra}, visible boolean, version int, sequence int").write.parquet(f"{tmp_path}/{table}.parquet")
    spark.createDataFrame([(1, "A"), (2, "B")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = {(r.obj, r.id): (r.name, r.page, r.title, r.url) for r in derived.QUERIES["tag_links_all"](spark, str(tmp_path)).collect()}
    whole = ("fr B", "https://de.wikipedia.org/wiki/B%20x%2Ay", "B x*y", "http://a.b/%27B")
    assert len(got) == 7 and got["node", 12] == got["way", 12] == got["relation", 12] == whole
    assert got["node", 11] == ("fr A", "https://en.wikipedia.org/wiki/x%20y", None, "http://a.b/%27A")
    assert got["node", 15] == ("n", None, None, None) and got["node", 16] == got["node", 17] == (None,) * 4
