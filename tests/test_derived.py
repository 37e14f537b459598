import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.build import changes, codes, fixed, grid, nodes, relations, rows, source, ways
from wayloom.model import Source
from wayloom.operators.filtered import FilteredTable
from wayloom.operators.groups import GroupedWayTable
from wayloom.operators.hierarchy import RelationHierarchy
from wayloom.operators.relational import apply_changes, difference
from wayloom.operators.segments import SegmentsTable, chain
from wayloom.operators.transformed import TransformedTable
from wayloom.operators.ways import PlainWayTable, RelationWayTable

HAS_FOO = "map_contains_key(tags, 'foo')"


def filter_case(spark, view, after, *change):
    before = FilteredTable(source(relations(spark, {1: ("", {"foo": "a", "name": "b"}), 2: ("", {"type": "x"})})), HAS_FOO, view)
    old = before.construct()
    assert rows(old, "id") == [(1,)]
    new = FilteredTable(source(relations(spark, after), spark, *change), HAS_FOO, view).update(old)
    return codes(new.change), [r[0] for r in rows(new.data, "id")]


FOO, PLAIN = ("", {"foo": "a"}), ("", {"type": "x"})


@pytest.mark.parametrize(
    "after, change, full, view, left",
    [
        ({1: FOO, 2: PLAIN, 10: PLAIN, 11: FOO}, ("C10", "M11"), ["M11"], ["D10", "M11"], [1, 11]),
        ({2: PLAIN}, ("D1",), ["D1"], ["D1"], []),
        ({1: FOO}, ("D2",), [], ["D2"], [1]),
        ({1: FOO, 2: FOO}, ("M2",), ["M2"], ["M2"], [1, 2]),
        ({1: PLAIN, 2: PLAIN}, ("M1",), ["D1"], ["D1"], []),
    ],
)
def test_filter(spark, after, change, full, view, left):
    assert filter_case(spark, False, after, *change) == (full, left)
    assert filter_case(spark, True, after, *change) == (view, left)


def test_filter_takes_null_as_false(spark):
    rel = relations(spark, {1: ("", {"foo": "1"}), 2: ("", {})})
    assert rows(FilteredTable(source(rel), "tags['foo'] = '1'").construct(), "id") == [(1,)]


def transform(spark, data, *change):
    src = source(data, spark, *change) if change else source(data)
    return TransformedTable(
        src, {"a": F.try_element_at("tags", F.lit("foo")).cast("int"), "b": F.coalesce(F.try_element_at("tags", F.lit("bar")).cast("int"), F.lit(0))},
        ~F.map_contains_key("tags", "ignore"),
    )


def test_transform(spark):
    tags = {2: {"foo": "3"}, 3: {"foo": "100", "bar": "4"}, 5: {"bar": "49"}, 6: {"foo": "1", "ignore": "1"}, 10: {"xxx": "1"}}
    make = lambda t: nodes(spark, *((i, 0, 0, v) for i, v in t.items()))
    old = fixed(transform(spark, make(tags)).construct())
    assert rows(old.fillna(-1), "id", "a", "b") == [(2, 3, 0), (3, 100, 4), (5, -1, 49), (10, -1, 0)]
    for change, new, want in [
        ("D5", {k: v for k, v in tags.items() if k != 5}, ["D5"]),
        ("D6", {k: v for k, v in tags.items() if k != 6}, []),
        ("M2", tags | {2: {"foo": "3", "ignore": ""}}, ["D2"]),
        ("M6", tags | {6: {"foo": "1"}}, ["A6"]),
        ("M3", tags | {3: {"foo": "99", "bar": "4"}}, ["M3"]),
        ("M10", tags | {10: {"xxx": "1", "yyy": "2"}}, []),
        ("C99", tags | {99: {}}, ["A99"]),
    ]:
        got = transform(spark, make(new), change).update(old)
        assert codes(got.change) == want, change
        assert rows(got.data.fillna(-1), "id", "a", "b") == rows(transform(spark, make(new)).construct().fillna(-1), "id", "a", "b")


def test_transform_by_function(spark):
    t = TransformedTable(source(grid(spark, 1, 2, 3)), function=lambda df: df[df.id > 1][["id"]].assign(double=lambda d: d.id * 2), schema="double bigint")
    assert rows(t.construct(), "id", "double") == [(2, 4), (3, 6)]


@pytest.mark.parametrize("view", [False, True])
def test_filter_before_transform(spark, view):
    make = lambda t: nodes(spark, *((i, 0, 0, v) for i, v in t.items()))
    first, then = {1: {"foo": "3"}, 2: {}}, {1: {}, 2: {"foo": "4"}}
    f0 = FilteredTable(source(make(first)), HAS_FOO, view).construct()
    old = transform(spark, f0).construct()
    f1 = FilteredTable(source(make(then), spark, "M1", "M2"), HAS_FOO, view).update(f0)
    t = TransformedTable(f1, {"a": F.try_element_at("tags", F.lit("foo")).cast("int")})
    assert codes(t.update(old.select("id", "a")).change) == ["A2", "D1"]


def test_plain_ways(spark):
    n = grid(spark, 1, 2, 3, 34, 36)
    old = PlainWayTable(source(ways(spark, {101: [1, 2], 103: [34, 1, 36], 105: [1], 106: [1, 99]})), source(n)).construct()
    old = fixed(old)
    assert rows(old, "id", "nodes") == [(101, (1, 2)), (103, (34, 1, 36))]
    moved = nodes(spark, (1, 1.0001, 1), (2, 7, 7), (34, 1.0034, 1), (36, 1.0036, 1), (3, 1.0003, 1))

    def update(spec, change, locations=n, node_change=()):
        t = PlainWayTable(source(ways(spark, spec), spark, *change), source(locations, spark, *node_change))
        got = t.update(old)
        assert rows(got.data, "id", "nodes", "geom") == rows(t.construct(), "id", "nodes", "geom")
        return codes(got.change)

    base = {101: [1, 2], 103: [34, 1, 36]}
    assert update(base | {3: [1, 3]}, ["C3"]) == ["A3"]
    assert update({103: [34, 1, 36]}, ["D101"]) == ["D101"]
    assert update(base | {101: [1, 2, 3]}, ["M101"]) == ["M101"]
    assert update(base | {101: [1]}, ["M101"]) == ["D101"]
    assert update(base, [], moved, ["M2"]) == ["M101"]


def test_equal_points_are_nudged(spark):
    n = nodes(spark, (1, 5, 5), (2, 5, 5), (3, 5, 5), (4, 6, 5))
    got = PlainWayTable(source(ways(spark, {1: [1, 2, 3, 4, 4]})), source(n)).construct().collect()[0].geom
    assert [p.x for p in got] == [5.0, 5.00000001, 5.0, 6.0, 6.00000001]


def rel_ways(spark, w, r, n=None, wc=(), rc=(), nc=(), **kw):
    return RelationWayTable(source(ways(spark, w), spark, *wc), source(relations(spark, r), spark, *rc), None if n is None else source(n, spark, *nc), **kw)


def test_relation_ways(spark):
    w = {1: [1, 2], 2: [2, 3], 3: [3, 4], 9: [4, 5]}
    r = {1: "w1 w2", 2: "w2 w3 w8 n9 r1"}
    old = fixed(rel_ways(spark, w, r).construct())
    assert rows(old, "id", "rels") == [(1, (1,)), (2, (1, 2)), (3, (2,))]

    def update(w, r, **kw):
        t = rel_ways(spark, w, r, **kw)
        got = t.update(old)
        assert rows(got.data, "id", "rels", "nodes") == rows(t.construct(), "id", "rels", "nodes")
        return codes(got.change)

    assert update(w, r | {20: "w1"}, rc=["C20"]) == ["M1"]
    assert update(w, {1: "w1 w2"}, rc=["D2"]) == ["D3", "M2"]
    assert update(w | {8: [7, 8]}, r, wc=["C8"]) == ["A8"]
    assert update(w | {1: [1, 2, 7]}, r, wc=["M1"]) == ["M1"]
    assert update(w | {1: ([1, 2], {"a": "b"})}, r, wc=["M1"]) == []
    assert update(w, r | {1: "w2"}, rc=["M1"]) == ["D1"]
    assert update(w, r | {1: "w1@x w2 n3"}, rc=["M1"]) == []
    assert update({k: v for k, v in w.items() if k != 1}, r, wc=["D1"]) == ["D1"]


def test_relation_ways_with_geometry_and_tags(spark):
    n = grid(spark, 1, 2, 3)
    w, r = {1: ([1, 2], {"name": "a"}), 2: ([2], {"name": "b"}), 3: ([2, 3], {})}, {1: "w1 w2 w3"}
    kw = dict(columns={"label": F.upper(F.try_element_at("tags", F.lit("name")))}, keep=F.map_contains_key("tags", "name"))
    old = rel_ways(spark, w, r, n, **kw).construct()
    assert rows(old, "id", "label") == [(1, "A")]
    moved = nodes(spark, (1, 1, 1), (2, 9, 9), (3, 3, 3))
    assert codes(rel_ways(spark, w, r, moved, nc=["M2"], **kw).update(old).change) == ["M1"]
    assert codes(rel_ways(spark, w | {3: ([2, 3], {"name": "c"})}, r, n, wc=["M3"], **kw).update(old).change) == ["A3"]


def seg_rows(df):
    return sorted((tuple(r.nodes), tuple(r.ways)) for r in df.collect())


def build_segments(spark, spec):
    spec = {k: v if isinstance(v, tuple) else (v, {"a": "1"}) for k, v in spec.items()}
    return SegmentsTable(source(ways(spark, spec)), ["tags"]).construct()


A, B = {"a": "1"}, {"a": "2"}


@pytest.mark.parametrize(
    "spec, want",
    [
        ({23: [1, 2, 3], 32: [3, 4, 5, 6]}, [((1, 2, 3, 4, 5, 6), (23, 32))]),
        ({23: [3, 2, 1], 32: [3, 4, 5, 6]}, [((1, 2, 3, 4, 5, 6), (23, 32))]),
        ({1: ([1, 2], A), 2: ([2, 3], B)}, [((1, 2), (1,)), ((2, 3), (2,))]),
        ({1: [3, 4, 5], 2: [1, 2, 3], 3: [6, 5]}, [((1, 2, 3, 4, 5, 6), (1, 2, 3))]),
        ({1: [1, 2, 3], 2: [4, 5], 3: [3, 6, 4, 7, 3]}, [((1, 2, 3), (1,)), ((3, 6, 4), (3,)), ((3, 7, 4), (3,)), ((4, 5), (2,))]),
        ({1: [1, 2, 3], 2: [3, 4, 5, 6], 3: [1, 7, 6]}, [((1, 2, 3, 4, 5, 6, 7, 1), (1, 2, 3))]),
        ({1: [6, 8, 7, 1, 6], 2: [1, 2]}, [((1, 2), (2,)), ((1, 6, 8, 7, 1), (1,))]),
        ({1: [1, 2], 2: [1, 3], 3: [1, 4]}, [((1, 2), (1,)), ((1, 3), (2,)), ((1, 4), (3,))]),
        ({1: ([3, 2, 1, 4, 5], A), 2: ([1, 6], B)}, [((1, 2, 3), (1,)), ((1, 4, 5), (1,)), ((1, 6), (2,))]),
        ({1: ([1, 2, 3], A), 2: ([4, 2, 5], B)}, [((1, 2), (1,)), ((2, 3), (1,)), ((2, 4), (2,)), ((2, 5), (2,))]),
        ({1: [1], 2: [2, 3]}, [((2, 3), (2,))]),
        ({1: [1, 2, 3, 1]}, [((1, 2, 3, 1), (1,))]),
    ],
)
def test_segments(spark, spec, want):
    assert seg_rows(build_segments(spark, spec)) == want


def test_chain_of_two_pieces_round():
    assert chain([([1, 2, 3], [1, 3]), ([3, 4, 1], [3, 1])]) == [1, 2, 3, 4, 1]


def test_segment_update_keeps_a_fork_apart(spark):
    old_ways = {1: ([1, 2], A), 2: ([2, 3], A), 3: ([2, 9], A)}
    new_ways = old_ways | {4: ([0, 1], A), 5: ([3, 4], A)}
    old = SegmentsTable(source(ways(spark, old_ways)), ["tags"]).construct()
    new = SegmentsTable(source(ways(spark, new_ways), spark, "C4", "C5"), ["tags"]).update(old)
    assert seg_rows(new.data) == [((0, 1, 2), (1, 4)), ((2, 3, 4), (2, 5)), ((2, 9), (3,))]
    assert sorted(c[0] for c in codes(new.change)) == ["A", "A", "D", "D"]


@pytest.mark.parametrize("seed", range(1))
def test_updates_give_what_construction_gives(spark, seed):
    rng = random.Random(seed)
    pick = lambda: ([rng.randrange(12) for _ in range(rng.randrange(2, 5))], rng.choice([A, B]))
    before = {i: pick() for i in range(12)}
    after = dict(before)
    change = []
    for i in rng.sample(range(16), 5):
        if i in after and rng.random() < 0.4:
            del after[i]
            change.append(f"D{i}")
        else:
            change.append(f"{'M' if i in after else 'C'}{i}")
            after[i] = pick()
    n = grid(spark, *range(12))
    for make in (
        lambda w, *c: SegmentsTable(source(ways(spark, w), *((spark, *c) if c else ())), ["tags"], source(n, spark)),
        lambda w, *c: PlainWayTable(source(ways(spark, w), *((spark, *c) if c else ())), source(n, spark)),
    ):
        old = make(before).construct()
        old = fixed(old)
        got, want = make(after, *change).update(old), make(after).construct()
        assert rows(got.data, "id", "nodes", "geom") == rows(want, "id", "nodes", "geom")
        assert {(r.id, r.action) for r in got.change.collect()} == {(r.id, r.action) for r in difference(old, want).collect()}
    group = lambda w, *c: GroupedWayTable(source(ways(spark, w), *((spark, *c) if c else ())), ["tags"])
    old = group(before).construct()
    old = fixed(old)
    sets = lambda df: sorted(tuple(sorted(r.child for r in g)) for _, g in itertools.groupby(sorted(df.collect()), key=lambda r: r.id))
    assert sets(group(after, *change).update(old).data) == sets(group(after).construct())


def group_case(spark, before, after, *change):
    g = lambda w, *c: GroupedWayTable(source(ways(spark, w), *((spark, *c) if c else ())), ["tags"])
    old = g(before).construct()
    old = fixed(old)
    new = g(after, *change).update(old)
    return rows(old, "id", "child"), codes(new.change), rows(new.data, "id", "child")


def test_groups(spark):
    base = {5: [1, 2, 3], 6: [4, 5], 7: [5, 6]}
    old, change, new = group_case(spark, base, base | {8: [6, 8]}, "C8")
    assert (old, change) == ([(6, 6), (6, 7)], ["M6"]) and new == [(6, 6), (6, 7), (6, 8)]
    assert group_case(spark, {5: [1, 2, 3]}, {5: [1, 2, 3], 6: [3, 4]}, "C6")[1:] == (["A5"], [(5, 5), (5, 6)])
    two = {6: [1, 2], 7: [2, 3], 10: [5, 6], 11: [6, 7]}
    assert group_case(spark, two, two | {12: [3, 5]}, "C12")[1] == ["D10", "M6"]
    assert group_case(spark, two, {6: [1, 2], 10: [5, 6], 11: [6, 7]}, "D7")[1] == ["D6"]
    five = {6: [1, 2], 7: [2, 3], 8: [3, 4], 9: [4, 5], 10: [5, 6]}
    got = group_case(spark, five, {k: v for k, v in five.items() if k != 8}, "D8")
    assert got[1] == ["A9", "M6"]
    assert group_case(spark, {1: ([1, 2], A), 2: ([2, 3], B), 3: ([1, 9, 2], A)}, {}, "D1")[0] == [(1, 1), (1, 3)]


def test_hierarchy(spark):
    h = lambda spec, **kw: rows(RelationHierarchy(source(relations(spark, spec)), **kw).construct(), "parent", "child", "depth")
    assert h({1: "r2", 2: "r3", 3: "w1"}) == [(1, 2, 2), (1, 3, 3), (2, 3, 2)]
    assert h({1: "r2", 2: "r1"}) == [(1, 2, 2), (2, 1, 2)]
    assert h({1: "r1 w1"}) == []
    seven = {i: f"r{i + 1}" for i in range(1, 7)} | {7: "w1"}
    assert max(d for _, _, d in h(seven)) == 5 and (1, 7, 7) in h(seven, depths=None)
    assert (1, 4, 3) in h({1: "r2 r3 r2", 2: "r4", 3: "r5", 5: "r4"})
    assert (3, 3, 1) in h({3: "w1"}, self_ref=True)


def test_apply_changes_and_difference(spark):
    old = grid(spark, 1, 2, 3)
    batch = nodes(spark, (2, 8, 8), (4, 9, 9), (3, 0, 0)).withColumn("action", F.when(F.col("id") == 3, "D").otherwise("M"))
    new = apply_changes(old, batch)
    assert [r[0] for r in rows(new, "id")] == [1, 2, 4]
    assert codes(difference(old, new)) == ["A4", "D3", "M2"]
    assert codes(difference(old, old)) == []
