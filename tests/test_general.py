"""The general data operators against brute force, and with awkward input."""

import datetime as dt
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.build import rows
from wayloom.model import current_rows, current_values
from wayloom.operators import forest, increment, nested, orphans, proximity, widen
from wayloom.session import fresh_folder

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


# current rows


def test_current_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, 5, "a", 1.0), (1, 2, 3, "b", None), (1, 2, 4, "c", 3.0), (None, 9, 9, "x", 0.0), (2, None, None, "d", 4.0), (2, 1, None, "e", 5.0)],
        "id bigint, version int, sequence int, name string, x double",
    )
    assert rows(current_rows(df, ["name"]), "id", "name") == [(1, "c"), (2, "e")]
    assert rows(current_values(df, ["x"]), "id", "x") == [(1, 3.0), (2, 5.0)]
    assert current_rows(df.limit(0), ["name"]).count() == 0


# 1: orphans

PARENT = "id bigint, version int, visible boolean, date timestamp, block string, state string"
REF = "src string, src_id bigint, ref_type string, ref_id bigint, date timestamp, state string, code int, first int"


@pytest.mark.parametrize("seed", range(2))
def test_orphans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parents = [
        (rng.choice([i, i, None]) if rng.random() < 0.1 else i, v, rng.choice([True, True, False, None]), day(rng.choice([None, rng.randrange(60)])), "b", "s")
        for i in list(range(250, 270)) + list(range(500, 530, 3)) + [-5, -4, -3, 2**40]
        for v in range(1, rng.randrange(2, 4))
    ]
    refs = [("ways", k, rng.choice(["N", "N", "W", None]), rng.choice([None, *range(248, 274), *range(495, 535), -6, -4, 2**40, 2**40 + 1]), day(rng.choice([None, rng.randrange(60)])), "x", 1, 2) for k in range(400)]
    refs = [*dict.fromkeys(refs)]
    last, first = {}, {}
    for i, v, visible, date, *_ in parents:
        if i is not None:
            last[i] = max(last.get(i, (0, False)), (v, visible is False))
            if v == 1 and date is not None:
                first[i] = min(first.get(i, date), date)
    want = []
    for src, sid, t, ref, date, *_ in refs:
        if t is None or ref is None:
            continue
        state = None
        if t == "W" or ref not in last:
            state = "missing"
        elif last[ref][1]:
            state = "deleted"
        elif date is not None and ref in first and first[ref] > date:
            state = "late"
        if state:
            want.append((src, sid, t, ref, state, date.strftime("%Y-%m") if date else "none"))
    codes = orphans.parent_rows(spark.createDataFrame(parents, PARENT), "N")
    got = orphans.orphan_references(spark.createDataFrame(refs, REF), [codes])
    assert rows(got, "src", "src_id", "ref_type", "ref_id", "state", "period") == sorted(want)


def test_runs_compress_keys(spark):
    keys = [(i, 1, not 1010 <= i <= 1012, day(i % 7), "", "") for i in range(1000, 1300) if i != 1005]
    runs = orphans.key_runs(orphans.key_slots(orphans.parent_rows(spark.createDataFrame(keys, PARENT), "N")))
    assert rows(runs, "start", "end", "deleted") == [(1000, 1004, False), (1006, 1009, False), (1010, 1012, True), (1013, 1023, False), (1024, 1299, False)]
    assert {r.latest for r in runs.where("start = 1024").collect()} == {int((day(6) - dt.datetime(1970, 1, 1, tzinfo=DAY.tzinfo)).total_seconds() * 1e6)}


def test_a_hot_parent_and_a_hot_reference(spark):
    parents = spark.range(20_000).selectExpr("IF(id % 3 = 0, 7, id) AS id", "INT(id % 5) AS version", "true AS visible", "timestamp'2024-01-01' AS date")
    refs = spark.range(20_000).selectExpr("'ways' AS src", "id AS src_id", "'N' AS ref_type", "IF(id % 3 = 0, 20001, id + 7) AS ref_id", "timestamp'2023-01-01' AS date")
    got = orphans.orphan_references(refs, [orphans.parent_rows(parents, "N")])
    states = {r.state: r["count"] for r in got.groupBy("state").count().collect()}
    there = {7 if i % 3 == 0 else i for i in range(20_000)}
    first = {7 if i % 3 == 0 else i for i in range(20_000) if i % 5 == 1}
    want = [20_001 if i % 3 == 0 else i + 7 for i in range(20_000)]
    assert states == {"missing": sum(w not in there for w in want), "late": sum(w in first for w in want)}


def test_orphans_of_empty_tables(spark):
    none = orphans.parent_rows(spark.createDataFrame([], PARENT), "N")
    one = spark.createDataFrame([("ways", 1, "N", 5, None, "", 0, 0)], REF)
    assert orphans.orphan_references(one, [none]).collect()[0].state == "missing"
    assert orphans.orphan_references(one.limit(0), [none]).count() == 0


def test_references(spark):
    ways = spark.createDataFrame([(1, [5, None, 5, 6], DAY), (2, None, None), (3, [], DAY)], "id bigint, nodes array<bigint>, date timestamp")
    assert rows(orphans.way_references(ways).where("ref_id IS NOT NULL"), "src_id", "ref_id") == [(1, 5), (1, 6)]
    rel = spark.createDataFrame(
        [(1, [(5, "a", "n"), (5, "b", "N"), (None, "", "W"), (7, None, None), None, (8, "", "x")], DAY)],
        "id bigint, members array<struct<id:bigint,role:string,type:string>>, date timestamp",
    )
    assert [r for r in orphans.member_references(rel).select("ref_type", "ref_id").collect() if r.ref_id] == [("N", 5)]


# 2: nested records


def parts_of(out):
    return nested.named_parts(*(nested.flat_table(out, t) for t in (nested.MEMBER, nested.TAG)))


def emitted(spark, *payloads):
    df = spark.createDataFrame([(i, i, p, "x", "y") for i, p in enumerate(payloads)], "record_id bigint, sequence int, payload string, tag string, key string")
    return nested.emit_tagged(df)


def test_nested_records(spark):
    record = {
        "id": 7, "tags": [{"k": "name", "v": {"en": "a", "de": {"old": None}}}, {"k": "empty", "v": {}}, {"k": None, "v": 1}, None], "meta": {"members": [{"type": "way", "ref": 1}], "tags": {"no": 1}},
        "members": [None, {"type": "Way", "ref": "0055", "role": None, "tags": {"x": 1, "y": None}, "members": {"type": "relation", "ref": 6.0, "members": [3, {"ref": 9}]}}, "text"],
    }
    got = rows(parts_of(emitted(spark, json.dumps(record))), "path", "kind", "name")
    assert got == sorted([
        ("", "tag", "name:en"), ("", "tag", "name:de:old"), ("1", "member", "W55"), ("1", "tag", "x"), ("1", "tag", "y"), ("1.0", "member", "R6"), ("1.0.1", "member", "9"),
    ])
    tree = {r.key: (r.parent, r.place) for r in nested.flat_table(emitted(spark, json.dumps(record)), "member").collect()}
    assert tree == {"1": ("", 1), "1.0": ("1", 0), "1.0.1": ("1.0", 1)}


def test_broken_and_odd_payloads(spark):
    bad = [None, "", "{", "[]", "null", "3", '{"a": NaN}', '{"members": [{"type": "w", "ref": 1}]', "{'a': 1}"]
    assert emitted(spark, *bad).count() == 0
    odd = ['{"members": null, "tags": 5}', '{"members": "x"}', '{"tags": {"a": "\\ud800"}}', '{"tags": {"é": [1, {"b": 2}]}}']
    assert rows(parts_of(emitted(spark, *odd, *odd)), "kind", "name") == sorted([("tag", "a"), ("tag", "a"), ("tag", "é"), ("tag", "é")])


def test_very_deep_and_very_long(spark):
    depth = 3000
    deep = '{"members": [{"type": "w", "ref": 1, "members": ' * depth + "[]" + "}]}" * depth
    wide = json.dumps({"members": [{"type": "n", "ref": i} for i in range(30_000)], "tags": {"t": "x" * 1_000_000}})
    got = parts_of(emitted(spark, deep, wide)).groupBy("record_id", "kind").count().collect()
    assert {(r.record_id, r.kind): r["count"] for r in got} == {(1, "member"): 30_000, (1, "tag"): 1, (0, "member"): 2 * depth - 1}
    chain = '{"type":"w","ref":1,"members":' * 2000 + "null" + "}" * 2000
    assert parts_of(emitted(spark, chain)).where("kind = 'member'").count() == 1999


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, false, null, "x\\n", {}, [], {"b": {"c": []}}]}', " [ ] ", '"x"', "12", '{"a": 1, "a": 2}'])
def test_own_parser(text):
    assert nested._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "01", "1 2", '{"a":}', "[", '{1: 2}', "nul", "]"])
def test_own_parser_refuses(text):
    with pytest.raises((ValueError, IndexError)):
        nested._parse_deep(text)


def test_tables_by_tag(spark, tmp_path):
    out = emitted(spark, '{"id": 3, "tags": {"a": "b"}, "members": [{"type": "n", "ref": 4, "role": "x"}]}')
    nested.write_tagged(out, str(tmp_path / "t"))
    assert rows(nested.read_tagged(spark, str(tmp_path / "t"), "member"), "key", "type", "ref", "role") == [("0", "N", "4", "x")]
    assert rows(nested.read_tagged(spark, str(tmp_path / "t"), "relation"), "id") == [("3",)]
    assert rows(nested.read_tagged(spark, str(tmp_path / "t"), "tag"), "parent", "name", "value") == [("", "a", "b")]


# 3: near points


def distance(a, b):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * proximity.EARTH_M * math.asin(min(1, math.sqrt(h)))


POINT = "id bigint, x double, y double, code string, block int, ranges int"


@pytest.mark.parametrize("radius", [10.0, 5000.0])
def test_near_pairs_against_brute_force(spark, radius):
    rng = random.Random(int(radius))
    points, spread = {}, radius / 111_000 * 2
    for i in range(600):
        x, y = rng.choice([(0, 0.001), (180, 40), (-180, 40), (12.5, 89.99999), (-100, -90), (33, 60), (70, 89.9995)])
        y = max(-90.0, min(90.0, y + rng.uniform(-spread, spread)))
        x = (x + rng.uniform(-spread, spread) / max(0.05, math.cos(math.radians(y))) + 540) % 360 - 180
        points[i] = (x, y)
    points[600] = points[601] = (180.0, 40.0)
    points[602] = (-180.0, 40.0)
    df = spark.createDataFrame([(i, *p, "c", 1, 2) for i, p in points.items()], POINT)
    want = sorted((a, b) for a, b in itertools.combinations(points, 2) if distance(points[a], points[b]) <= radius)
    assert rows(proximity.near_pairs(df, radius), "node_a", "node_b") == want and len(want) > 100


def test_near_pairs_of_unusable_points(spark):
    odd = [(1, None, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 181.0, 1.0), (5, 1.0, 91.0), (6, float("nan"), 1.0), (None, 5.0, 5.0), (7, 5.0, 5.0), (8, 5.0, None)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in odd], POINT)
    assert proximity.near_pairs(df, 10.0).count() == 0
    assert proximity.near_pairs(df.limit(0), 10.0).count() == 0


@pytest.mark.parametrize("hot, tested", [(50, 100), (1, 7)])
def test_crowded_cells_are_salted(spark, monkeypatch, hot, tested):
    monkeypatch.setattr(proximity, "HOT", hot)
    monkeypatch.setattr(proximity, "TESTED", tested)
    rng = random.Random(hot)
    points = {i: (33 + rng.uniform(0, 2e-4), 60 + rng.uniform(0, 1e-4)) for i in range(240)} | {300 + i: (34.0, 60.0) for i in range(30)}
    df = spark.createDataFrame([(i, *p, "c", 1, 2) for i, p in points.items()], POINT)
    want = sorted((a, b) for a, b in itertools.combinations(points, 2) if distance(points[a], points[b]) <= 10)
    assert rows(proximity.near_pairs(df, 10.0), "node_a", "node_b") == want
    pairs, members = proximity.near_places(df, 10.0)
    assert rows(members, "place", "id") == [(300, 300 + i) for i in range(30)] and pairs.where("a >= 300").count() == 0


def inside(p, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_points_in_regions_against_brute_force(spark):
    rng = random.Random(3)
    points = {i: (rng.uniform(-180, 180), rng.uniform(-90, 90)) if i % 3 == 0 else (10 + rng.uniform(0, 0.02), 50 + rng.uniform(0, 0.02)) for i in range(500)}
    points[500], points[501] = (180.0, 90.0), (-180.0, -90.0)
    regions = {0: [(-170.0, -80.0), (170.0, -80.0), (0.0, 85.0)], 1: [(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)], 2: [(10.0, 50.0), (10.0, 50.0), (10.0, 50.0)]}
    for k in range(3, 40):
        x, y, size = 10 + rng.uniform(0, 0.02), 50 + rng.uniform(0, 0.02), rng.choice([1e-4, 1e-3, 1e-2])
        regions[k] = [(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.choice([3, 4, 9]))]
        if k % 2:
            regions[k].append(regions[k][0])
    regions[40] = [points[i] for i in (1, 2, 4, 5)]  # points on the ring itself
    p = spark.createDataFrame([(i, *v, "c", 1, 2) for i, v in points.items()] + [(None, 1.0, 1.0, "", 0, 0), (900, None, 1.0, "", 0, 0)], POINT)
    r = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v], 1.0) for k, v in regions.items()] + [(91, None, 0.0), (92, [{"x": 1.0, "y": None}] * 4, 0.0), (93, [], 0.0)], "id bigint, ring array<struct<x:double,y:double>>, x double")
    want = sorted((k, i) for k, ring in regions.items() for i, v in points.items() if inside(v, ring))
    assert rows(proximity.points_in_regions(p, r), "region", "point") == want and len(want) > 600
    assert proximity.points_in_regions(p.limit(0), r).count() == 0 and proximity.points_in_regions(p, r.limit(0)).count() == 0


# 5: new and changed records

FEED = "id bigint, version int, sequence int, date timestamp, feed string, part string, size int"
STATUS = "part string, date timestamp, sequence int, state string, feed int"


@pytest.mark.parametrize("parts", [3, 70])
def test_pending_changes_against_brute_force(spark, parts):
    rng = random.Random(parts)
    feeds = {
        f: [(rng.choice([None, *range(8)]), rng.choice([None, 1, 2]), rng.choice([None, *range(6)]), day(rng.choice([None, *range(9)])), "", "", 0) for _ in range(60)]
        for f in ("node", "way")
    }
    status = [(rng.choice([None, *(f"p{i}" for i in range(parts))]), day(rng.choice([None, *range(9)])), rng.choice([None, *range(7)]), rng.choice(["ok", "ok", "failed", None]), 0) for _ in range(3 * parts)]
    marks = {}
    for part, date, seq, state, _ in status:
        if part is None:
            continue
        marks.setdefault(part, None)
        if state == "ok" and seq is not None:
            key = (seq, date is not None, date or DAY)
            if marks[part] is None or key > marks[part]:
                marks[part] = key
    want = set()
    for part, mark in marks.items():
        for feed, some in feeds.items():
            for change in {(i, v) for i, v, *_ in some}:
                handled = mark is not None and mark[1] and any(
                    (i, v) == change and s is not None and d is not None and s <= mark[0] and d <= mark[2] for i, v, s, d, *_ in some
                )
                if not handled:
                    want.add((part, feed, *change))
    got = increment.pending_changes({f: spark.createDataFrame(r, FEED) for f, r in feeds.items()}, spark.createDataFrame(status, STATUS), fresh_folder(spark, "p5"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_pending_changes_of_empty_tables(spark):
    feed, status = spark.createDataFrame([(1, 1, 1, DAY, "", "", 0)], FEED), spark.createDataFrame([("a", DAY, 1, "ok", 0)], STATUS)
    pending = lambda f, s: increment.pending_changes({"node": f}, s, fresh_folder(spark, "p5"))
    assert pending(feed, status.limit(0)).count() == 0
    assert pending(feed.limit(0), status).count() == 0
    assert pending(feed, status).count() == 0
    assert rows(pending(feed, spark.createDataFrame([("a", DAY, None, "ok", 0)], STATUS)), "part", "id") == [("a", 1)]


def feed_state(spark):
    """Part a has handled sequence 1, part b nothing."""
    status = spark.createDataFrame([("a", day(1), 1, "ok", 0), ("b", None, None, "failed", 0)], STATUS)
    feed = lambda *r: {"node": spark.createDataFrame([(i, 1, s, day(s), "", "", 0) for i, s in r], FEED)}
    inc = increment.FeedIncrement(spark, fresh_folder(spark, "p5"))
    inc.adopt(feed((1, 1), (2, 1)), status)
    return inc, feed


def brought(inc, batch):
    return rows(inc.delivered(batch), "part", "id")


def test_runs_bring_each_change_once(spark):
    inc, feed = feed_state(spark)
    assert brought(inc, inc.run(feed((1, 1), (2, 1)))) == [("b", 1), ("b", 2)]
    assert inc.run(feed((1, 1), (2, 1))) is None
    # unit 1 gets a late row, and its row 2 is delivered again in a new unit
    later = feed((1, 1), (2, 1), (9, 1), (2, 2), (3, 2), (3, 2))
    assert brought(inc, inc.run(later)) == [("a", 3), ("a", 9), ("b", 3), ("b", 9)]
    assert inc.run(later) is None


def test_the_manifest_decides_what_is_read(spark):
    inc, feed = feed_state(spark)
    now = feed((1, 1), (2, 1), (3, 2))
    unit = inc.listing(now).where("sequence = 2").select(F.lit(0).alias("part"), "feed", "sequence", "size", "checksum")
    inc.log.write("manifest", unit)
    inc.log.commit()
    assert brought(inc, inc.run(now)) == [("b", 1), ("b", 2), ("b", 3)]


@pytest.mark.parametrize("step", ["manifest", "output", "commit"])
def test_a_run_that_fails_neither_skips_nor_repeats(spark, monkeypatch, step):
    inc, feed = feed_state(spark)
    now, write, commit = feed((1, 1), (2, 1), (3, 2)), inc.log.write, inc.log.commit

    def failing(kind, df):
        write(kind, df)
        if kind == step:
            raise RuntimeError(step)

    def stop():
        raise RuntimeError(step)

    monkeypatch.setattr(inc.log, "write", failing)
    monkeypatch.setattr(inc.log, "commit", stop if step == "commit" else commit)
    with pytest.raises(RuntimeError):
        inc.run(now)
    monkeypatch.setattr(inc.log, "write", write)
    monkeypatch.setattr(inc.log, "commit", commit)
    again = increment.FeedIncrement(spark, inc.log.folder)
    more = feed((1, 1), (2, 1), (3, 2), (4, 3))
    assert brought(again, again.run(more)) == [("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    assert again.run(more) is None


def test_many_parts(spark):
    status = spark.createDataFrame([(f"p{k:03d}", day(1), k % 3, "ok", 0) for k in range(130)], STATUS)
    feed = {"node": spark.createDataFrame([(1, 1, 1, day(1), "", "", 0), (2, 1, 2, day(1), "", "", 0)], FEED)}
    got = increment.pending_changes(feed, status, fresh_folder(spark, "p5"))
    assert rows(got, "part", "id") == sorted((f"p{k:03d}", i) for k in range(130) for i in (1, 2) if k % 3 < i)


# 6: hierarchies


def brute_hierarchies(links):
    links = {(p, c) for p, c in links if p is not None and c is not None and p != c}
    kids = {}
    for p, c in links:
        kids.setdefault(p, set()).add(c)
    reach = {}
    for v in {x for e in links for x in e}:
        seen, todo = set(), [v]
        while todo:
            for c in kids.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        reach[v] = seen
    out = []
    for v, r in reach.items():
        if v in r:
            out.append(("cycle", v, min(u for u in r if v in reach[u]), 0, ""))
    def go(path):
        out.append(("path", path[-1], path[0], len(path), "/".join(map(str, path))))
        for c in kids.get(path[-1], ()):
            if c not in path:
                go(path + [c])
    for root in kids.keys() - {c for _, c in links}:
        go([root])
    return sorted(out)


LINK = "parent bigint, child bigint, root int, component int, kind string"


@pytest.mark.parametrize("seed, task_links, task_paths", [(0, 200_000, 1_000_000), (0, 0, 1), (1, 3, 1), (2, 200_000, 3)])
def test_hierarchies_against_brute_force(spark, seed, task_links, task_paths):
    rng = random.Random(seed)
    links = [(rng.choice([None, *range(40)]), rng.choice([None, *range(40)])) for _ in range(36)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 201), (201, 200), (200, 201), (300, 300)]
    df = spark.createDataFrame([(p, c, 0, 0, "") for p, c in links], LINK).repartition(5)
    got = rows(forest.hierarchies(df, task_links, task_paths), "kind", "id", "root", "depth", "path")
    assert got == brute_hierarchies(links)


def test_a_component_with_many_paths_is_split(spark):
    """Eight layers of three, all linked to the next: 3 + 9 + ... paths, of which a task gives a thousand."""
    links = [(3 * k + i, 3 * k + 3 + j) for k in range(7) for i in range(3) for j in range(3)]
    got = forest.hierarchies(spark.createDataFrame([(p, c, 0, 0, "") for p, c in links], LINK), task_paths=1000).cache()
    assert got.count() == got.distinct().count() == sum(3**k for k in range(1, 9)) and got.where("depth != size(split(path, '/'))").count() == 0
    whole = forest.Component([p for p, _ in links], [c for _, c in links], [c // 3 for _, c in links], False)
    parts = [list(whole.rows((k, 5))) for k in range(5)]
    assert sorted(r for p in parts for r in p) == sorted(whole.rows((0, 1))) and max(map(len, parts)) < 6000


def test_merging_of_large_sets(spark, monkeypatch):
    monkeypatch.setattr(forest, "MERGE_LINKS", 10)
    star = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 400)]
    got = forest.components(spark.createDataFrame(star, "parent bigint, child bigint").repartition(20))
    assert got.count() == 301 and rows(got.groupBy("component").agg(F.count("vertex").alias("n"), F.max("offset").alias("o"), F.min("offset").alias("u")).selectExpr("n", "o - u AS depth"), "n", "depth") == [(101, 100), (200, 1)]


def test_hierarchies_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, ""), (None, 2, 0, 0, "")], LINK)
    assert forest.hierarchies(df).count() == 0


def test_components_of_a_long_chain(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child")).repartition(16)
    comp = forest.components(df)
    got = comp.agg(F.countDistinct("component"), F.count("vertex"), F.max("offset") - F.min("offset"), F.max(F.col("broken").cast("int"))).collect()[0]
    assert tuple(got) == (1, n + 1, n, 0)
    ring = df.unionByName(spark.createDataFrame([(n, 0)], "parent bigint, child bigint"))
    assert forest.components(ring).where("broken").count() == n + 1


# 7: wide tables

TYPES = {"n": "int", "d": "double", "b": "bool", "day": "date", "t": "text", "id": "text", "bad": "int"}


def test_widen(spark):
    tags = [
        (1, {"N": " +007 ", "d": "1.50", "b": "YES", "day": "2024-02-29", "t": "x", "id": "own", "other": "1"}),
        (2, {"n": "1.0", "d": ".5", "b": "maybe", "day": "2023-02-29", "t": "  "}),
        (3, {"n": "1", " N": "2", "d": "1.0", "D": "1", "b": "yes", "B": "1"}),
        (4, {"n": "1", "N ": "x", " n": "2"}),
        (5, None),
        (6, {}),
        (7, {"n": "9" * 30, "d": None, "b": ""}),
        (8, {"n": "٣", "day": "2024-1-1"}),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in tags], "id bigint, tags map<string,string>, state string")
    got = {r.id: r for r in widen.widen(df, ["id"], "tags", TYPES).collect()}
    assert (got[1].n, got[1].d, got[1].b, str(got[1].day), got[1].t, got[1].tag_id) == (7, 1.5, True, "2024-02-29", "x", "own")
    assert sorted(got[2].bad) == ["b", "d", "day", "n"] and got[2].n is None and got[2].t is None
    assert (got[3].conflict, got[3].n, got[3].d, got[3].b) == (["n"], None, 1.0, True)
    assert (got[4].bad, got[4].conflict) == (["n"], ["n"])
    assert got[5].bad == [] and got[6].n is None
    assert (got[7].unfit, got[7].n, got[7].bad) == (["n"], None, [])
    assert sorted(got[8].bad) == ["day", "n"]
    cells = rows(widen.unclean_cells(widen.widen(df, ["id"], "tags", TYPES), ["id"]), "id", "tag_key", "state")
    want = sorted((i, k, s) for i, r in got.items() for s in ("bad", "conflict") for k in r[s])
    assert cells == want
    assert widen.widen(df.limit(0), ["id"], "tags", TYPES).count() == 0


def test_rows_of_entries(spark):
    long = spark.createDataFrame(
        [(1, "n", "1"), (1, "N", "+1"), (1, " n ", "01"), (2, "n", "0"), (2, "n", "+1"), (2, "n", "1"), (3, "n", "x"), (3, "d", "2.0"), (4, None, "1"), (5, "n", None), (6, "zzz", "1")]
        + [(7, "n", str(i)) for i in range(500)],
        "id bigint, a string, v string",
    )
    wide = widen.widen_entries(long, ["id"], "a", "v", {"n": "int", "d": "double"})
    got = {r.id: (r.n, r.d, r.bad, r.conflict) for r in wide.collect()}
    assert got == {
        1: (1, None, [], []), 2: (None, None, [], ["n"]), 3: (None, 2.0, ["n"], []), 4: (None, None, [], []), 5: (None, None, [], []), 6: (None, None, [], []), 7: (None, None, [], ["n"]),
    }


def test_relations_through_the_visitor(spark):
    """Members as the plain explosion has them, tags as the maps hold them, one relation row a row."""
    from wayloom.model import read
    from wayloom.plans import pipelines

    d = "/root/testdata/sf0.001"
    got = pipelines.QUERIES["p2_relations"](spark, d).cache()
    count = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    relations = read(spark, d, "relations")
    kinds = {r.tag: r["count"] for r in got.groupBy("tag").count().collect()}
    assert kinds["relation"] == relations.count() and set(kinds) == {"relation", "member", "tag"}
    members = pipelines.p2_members(spark, d).selectExpr("id AS record_id", "sequence", "place", "coalesce(type, '') AS type", "coalesce(string(ref), '') AS ref", "role")
    assert count(got.where("tag = 'member'"), *members.columns) == count(members, *members.columns)
    tags = relations.selectExpr("id AS record_id", "sequence", "explode(tags) AS (name, value)")
    assert count(got.where("tag = 'tag'"), *tags.columns) == count(tags, *tags.columns)
    own = got.where("tag = 'relation'").selectExpr("record_id", "int(get_json_object(fields, '$.version')) AS version", "id")
    assert count(own, *own.columns) == count(relations.selectExpr("id AS record_id", "version", "coalesce(string(id), '') AS id"), *own.columns)


def test_all_tag_types_count(spark, tmp_path):
    from wayloom.plans import pipelines

    spark.range(10_050).selectExpr("concat('k', id) AS tag_key", "'int' AS col_type").write.parquet(f"{tmp_path}/tag_types.parquet")
    assert len(pipelines.tag_types(spark, str(tmp_path))) == 10_050


def test_numbers_and_depths_without_bound(spark):
    """Whole numbers longer than the library converts, and values deeper than it writes."""
    import json

    from wayloom.operators import nested, widen

    big, deep = "7" * 5000, "[" * 100_000 + f'{{"a": [1, {"7" * 5000}], "b": "\\u00e4"}}' + "]" * 100_000
    payload = f'{{"id": {big}, "version": 3, "x": {big}, "members": [{{"type": "way", "ref": -{big}, "role": "r"}}, {{"type": {big}, "ref": 5}}], "tags": [{{"k": {big}, "v": 1}}, {{"k": "n", "v": {big}}}, {{"k": "d", "v": {deep}}}]}}'
    rows = [(tag, json.loads(json.dumps(load))) for tag, _, _, _, load in nested.visit(nested.parse_record(payload))]
    assert [x for tag, x in rows if tag == "member"] == [{"type": "W", "ref": f"-{big}", "role": "r"}, {"type": "", "ref": "5", "role": None}]
    assert [x for tag, x in rows if tag == "tag"] == [{"name": "n", "value": big}, {"name": "d", "value": deep.replace("\\u00e4", "\u00e4")}]
    assert rows[0] == ("relation", {"id": big, "fields": f'{{"version": 3, "x": {big}}}'})
    df = spark.createDataFrame([(1, payload)], "record_id long, payload string").selectExpr("record_id", "1 AS sequence", "payload")
    names = {(r.kind, r.name) for r in parts_of(nested.emit_tagged(df)).collect()}
    assert names == {("member", f"W-{big}"), ("member", "5"), ("tag", "n"), ("tag", "d")}
    for value in ({"a": [1, 2.5, None, True, {"b": "\u00e4\""}], "c": {}, "d": []}, [], "x"):
        assert nested._written(value) == json.dumps(value, ensure_ascii=False)

    cells = [{"n": "0" * 5000 + "7"}, {"n": big}, {"n": big, " N ": "+0" + big}, {"n": big, "N": "-" + big}, {"n": "-" + "0" * 5000, "N": "0"}]
    wide = widen.widen(spark.createDataFrame(list(enumerate(cells)), "id long, tags map<string,string>"), ["id"], "tags", {"n": "int"})
    got = {r.id: (r.n, r.bad, r.conflict, r.unfit) for r in wide.collect()}
    assert got == {0: (7, [], [], []), 1: (None, [], [], ["n"]), 2: (None, [], [], ["n"]), 3: (None, [], ["n"], []), 4: (0, [], [], [])}
