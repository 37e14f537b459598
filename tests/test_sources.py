import bz2
import gzip
import io
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tests.build import changes, codes, grid, relations, rows, ways
from wayloom.model import Source
from wayloom.operators.filtered import FilteredTable
from wayloom.operators.increment import IncrementalFolder
from wayloom.operators.ways import PlainWayTable
from wayloom.plans.pipeline import Pipeline
from wayloom.sources import files, opl, pbf, snapshot, xmlmap
from wayloom.streaming import replication

LINES = [
    "n1 v1 dV t2024-01-02T03:04:05Z i7 uan%20%na Tname=a%2c%b,x=%1f600% x1.5 y-2.25",
    "n2 v2 dV T x1 y1",
    "n3 v4 dD",
    "",
    "w5 v1 dV Thighway=path Nn1,n2,n1",
    "r6 v1 dV Ttype=route Mw5@,n1@stop%20%here,R6@x",
    "c9 open",
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_opl(spark):
    got = {r.id: r for r in opl.parse(lines(spark, LINES)).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6]
    assert got[1].tags == {"name": "a,b", "x": "😀"} and (got[1].x, got[1].y, got[1].uid, got[1].user) == (1.5, -2.25, 7, "an na")
    assert got[1].date.isoformat().startswith("2024-01-02T03:04:05") and got[2].tags == {} and not got[3].visible and got[3].x is None
    assert got[5].nodes == [1, 2, 1]
    assert [(m.id, m.role, m.type) for m in got[6].members] == [(5, "", "W"), (1, "stop here", "N"), (6, "x", "R")]
    assert {r.id: r.action for r in opl.parse(lines(spark, LINES)).select("id", opl.action().alias("action")).collect()} == {1: "C", 2: "M", 3: "D", 5: "C", 6: "C"}


def test_opl_round_trip(spark):
    once = opl.parse(lines(spark, LINES)).drop("changeset", "user")
    again = opl.parse(opl.render(once)).drop("changeset", "user")
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_tagged_nodes_only(spark):
    objects = opl.parse(lines(spark, LINES))
    assert [r.id for r in opl.base_tables(objects, False)["node"].collect()] == [1]
    assert sorted(r.id for r in opl.locations(objects).collect()) == [1, 2]
    assert codes(opl.batches(objects, False)["node"]) == ["C1", "D2", "D3"]


XML = b"""<osm><bounds/><node id="1" version="1" lat="-2.25" lon="1.5" timestamp="2024-01-02T03:04:05Z" uid="7" user="an na">
<tag k="name" v="a,b"/></node><node id="3" version="4" visible="false"/><way id="5" version="1"><nd ref="1"/><nd ref="2"/></way>
<relation id="6" version="1"><member type="way" ref="5" role=""/><tag k="type" v="route"/></relation></osm>"""
CHANGE = b"""<osmChange><modify><node id="1" version="2" lat="0" lon="0"/></modify><delete><way id="5" version="2"/></delete></osmChange>"""


@pytest.mark.parametrize("end, pack", [("osm", bytes), ("osm.gz", gzip.compress), ("osm.bz2", bz2.compress)])
def test_xml(spark, tmp_path, end, pack):
    path = tmp_path / f"a.{end}"
    path.write_bytes(pack(XML))
    got = {r.id: r for r in xmlmap.read(spark, [f"file://{path}"]).collect()}
    assert (got[1].x, got[1].y, got[1].tags, got[1].uid) == (1.5, -2.25, {"name": "a,b"}, 7)
    assert not got[3].visible and got[5].nodes == [1, 2] and got[6].members[0].type == "W"


def test_xml_changes():
    got = [(r[0], r[1], r[3]) for r in xmlmap.objects(io.BytesIO(CHANGE))]
    assert got == [("N", 1, True), ("W", 5, False)]


def var(n):
    out = b""
    n &= (1 << 64) - 1
    while True:
        out += bytes([(n & 0x7F) | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def zig(n):
    return (n << 1) ^ (n >> 63)


def msg(number, data):
    return var(number << 3 | 2) + var(len(data)) + data


def num(number, n):
    return var(number << 3) + var(n)


def pack(values, signed=False, running=False):
    out, last = b"", 0
    for v in values:
        out, last = out + var(zig(v - last if running else v) if signed else v), v
    return out


def test_pbf(spark, tmp_path):
    strings = ["", "name", "a", "highway", "path", "stop", "ann"]
    table = msg(1, b"".join(msg(1, s.encode()) for s in strings))
    info = msg(1, pack([1, 3])) + msg(2, pack([1000, 2000], True, True)) + msg(3, pack([5, 5], True, True)) + msg(4, pack([7, 8], True, True)) + msg(5, pack([6, 6], True, True))
    dense = msg(1, pack([10, 4], True, True)) + msg(5, info) + msg(8, pack([15_000_000, -22_500_000], True, True)) + msg(9, pack([5, 10], True, True)) + msg(10, pack([1, 2, 0, 0]))
    way = num(1, 77) + msg(2, pack([3])) + msg(3, pack([4])) + msg(4, num(1, 2)) + msg(8, pack([10, 4, 10], True, True))
    rel = num(1, 88) + msg(8, pack([0, 5])) + msg(9, pack([77, 10], True, True)) + msg(10, pack([1, 0]))
    block = table + msg(2, msg(2, dense)) + msg(2, msg(3, way) + msg(4, rel))
    blob = num(2, len(block)) + msg(3, zlib.compress(block))
    head = msg(1, b"OSMData") + num(3, len(blob))
    first = msg(1, b"header")
    lead = msg(1, b"OSMHeader") + num(3, len(first))
    path = tmp_path / "a.osm.pbf"
    path.write_bytes(b"".join(struct.pack(">I", len(h)) + h + b for h, b in ((lead, first), (head, blob), (head, blob))))
    got = pbf.read(spark, [f"file://{path}"]).collect()
    assert len(got) == 8
    by = {r.id: r for r in got}
    assert (by[10].tags, by[10].version, by[10].user, by[10].uid, by[10].y, by[10].x) == ({"name": "a"}, 1, "ann", 7, 1.5, 5e-7)
    assert by[4].tags == {} and by[4].y == -2.25 and by[10].date.timestamp() == 1000
    assert by[77].nodes == [10, 4, 10] and by[77].tags == {"highway": "path"} and by[77].version == 2
    assert [(m.id, m.role, m.type) for m in by[88].members] == [(77, "", "W"), (10, "stop", "N")]


def pipeline(spark, folder):
    p = Pipeline(spark, str(folder), extra=1)
    p.add_table("named", lambda p: FilteredTable(p.source("way"), "map_contains_key(tags, 'name')"))
    p.add_table("lines", lambda p: PlainWayTable(p.source("named"), p.source("node")))
    return p


def test_pipeline(spark, tmp_path):
    p = pipeline(spark, tmp_path)
    assert p.get_option("extra") == 1 and p.get_option("none", 3) == 3 and not p.has_option("none")
    assert len(p.tables) == 2 and callable(p.tables.named) and "lines" in p.tables
    p.add_function("double", lambda self, n: 2 * n)
    assert p.double(4) == 8
    p.load({"node": grid(spark, 1, 2, 3), "way": ways(spark, {1: ([1, 2], {"name": "a"}), 2: ([2, 3], {})})}, 10)
    p.construct()
    assert rows(p.source("lines").data, "id") == [(1,)]
    assert (p.status.get_min_sequence(), p.status.get_sequence("lines")) == (10, 10)
    batch = {"way": ways(spark, {2: ([2, 3], {"name": "b"})}).withColumn("action", F.lit("M"))}
    assert p.apply(batch, 11)
    assert codes(p.source("named").change) == ["M2"] and codes(p.source("lines").change) == ["A2"]
    assert not p.apply(batch, 11)
    again = pipeline(spark, tmp_path)
    assert rows(again.source("lines").data, "id") == [(1,), (2,)] and again.status.get_sequence("lines") == 11
    again.finalize(compact=True)
    again.views()
    assert spark.sql("SELECT count(*) FROM lines").collect()[0][0] == 2
    assert again.exists()
    again.drop()
    assert not again.exists() and not again.store.has("lines") and again.status.get_sequence() is None


def test_failed_batch_leaves_the_old_tables(spark, tmp_path):
    p = pipeline(spark, tmp_path)
    p.load({"node": grid(spark, 1, 2), "way": ways(spark, {1: ([1, 2], {"name": "a"})})}, 1)
    p.construct()

    class Fails:
        def update(self, old):
            raise RuntimeError("stop")

    p.add_table("bad", lambda p: Fails())
    with pytest.raises(Exception):
        p.apply({"way": ways(spark, {1: ([1, 2], {})}).withColumn("action", F.lit("M"))}, 2)
    fresh = pipeline(spark, tmp_path)
    assert fresh.status.get_sequence() == 1 and rows(fresh.source("named").data, "id") == [(1,)]


def test_a_failed_batch_is_repeated_by_the_same_object(spark, tmp_path):
    p, fail = pipeline(spark, tmp_path), [True]
    p.load({"node": grid(spark, 1, 2, 3)}, 1)
    p.construct()

    class Fails(FilteredTable):
        def update(self, old):
            if fail[0]:
                raise RuntimeError("stop")
            return super().update(old)

    p.add_table("shaky", lambda p: Fails(p.source("way"), "true"))
    p.store.stage("shaky", Source(p.source("way").data))
    p.store.commit()
    batch = lambda i: {"way": ways(spark, {i: ([1, 2], {"name": "a"})}).withColumn("action", F.lit("C"))}
    with pytest.raises(RuntimeError):
        p.apply(batch(1), 2)
    assert p.status.get_sequence() == 1 and not p.store.staged
    fail[0] = False
    assert p.apply(batch(1), 2) and p.apply(batch(2), 3)
    for q in (p, pipeline(spark, tmp_path)):
        assert q.status.get_sequence() == 3 and rows(q.source("named").data, "id") == [(1,), (2,)] and rows(q.source("way").data, "id") == [(1,), (2,)]


def test_batches_write_what_they_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "LAYERS", 2)
    p = pipeline(spark, tmp_path)
    p.load({"node": grid(spark, 1, 2, 3), "way": ways(spark, {i: ([1, 2], {"name": "a"}) for i in range(1, 6)})}, 0)
    p.construct()
    base = p.store.state["tables"]["way"]["base"]
    want = {i: (1, 2) for i in range(1, 6)}
    for n, (change, gone) in enumerate([({1: [1, 3]}, False), ({1: [2, 3], 7: [1, 3]}, False), ({2: [1, 2]}, True), ({2: [3, 2]}, False)], 1):
        rows_ = ways(spark, {i: (v, {"name": "a"}) for i, v in change.items()})
        assert p.apply({"way": rows_.withColumn("action", F.lit("D" if gone else "M"))}, n)
        for i, v in change.items():
            want.pop(i, None)
            if not gone:
                want[i] = tuple(v)
        entry = p.store.state["tables"]["way"]
        assert (entry["base"] == base) == (n < 3) and len(entry["layers"]) == (n if n < 3 else n - 3)
        assert p.store.state["tables"]["node"]["base"] == 1
        for table in ("way", "named", "lines"):
            assert dict(rows(p.source(table).data, "id", "nodes")) == want, (n, table)
    p.finalize()
    assert not any(p.store.state["tables"][t]["layers"] for t in ("named", "lines"))
    assert dict(rows(spark.table("default.lines"), "id", "nodes")) == want
    spark.sql("DROP TABLE default.named")
    spark.sql("DROP TABLE default.lines")


def test_diffs_are_applied_in_order_and_once(spark, tmp_path):
    p = pipeline(spark, tmp_path / "db")
    p.load({"node": grid(spark, 1, 2, 3)}, 0)
    p.construct()
    diffs = tmp_path / "diffs"
    diffs.mkdir()
    (diffs / "001.opl").write_text("w1 v1 dV Tname=a Nn1,n2\n")
    (diffs / "002.opl").write_text("w1 v2 dV Tname=b Nn1,n3\nw2 v1 dV T Nn1,n2\n")
    assert replication.catch_up(p, str(diffs), max_kb=0) == [1]
    got = []
    replication.stream(spark, p, str(diffs), str(tmp_path / "at"), after=got.extend).awaitTermination(120)
    assert got == [2] and rows(p.source("lines").data, "id", "nodes") == [(1, (1, 3))]
    assert replication.catch_up(p, str(diffs)) == []


def test_nested_packed_diffs_with_states_and_places(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "db"), locations=True)
    p.add_table("lines", lambda p: PlainWayTable(p.source("way"), p.source("location")))
    found = opl.parse(lines(spark, ["n1 v1 dV T x1 y1", "n2 v1 dV Tname=a x2 y2", "n3 v1 dV T x3 y3", "w5 v1 dV Tname=a Nn1,n2", "w6 v1 dV T Nn1,n3"]))
    p.load(opl.base_tables(found, False) | {"location": opl.locations(found)}, 4600122)
    p.construct()
    at = tmp_path / "diffs" / "004" / "600"
    at.mkdir(parents=True)
    change = b'<osmChange><modify><node id="1" version="2" lat="9" lon="8"/></modify><delete><node id="3" version="2"/></delete></osmChange>'
    (at / "123.osc.gz").write_bytes(gzip.compress(change))
    (at / "123.state.txt").write_text("#x\nsequenceNumber=4600123\ntimestamp=2024-01-02T03\\:04\\:05Z\n")
    (at / "125.opl").write_text("w7 v1 dV T Nn1,n2\n")
    diffs = f"file://{tmp_path}/diffs"
    assert replication.catch_up(p, diffs, keep_empty_nodes=False) == [4600123]  # 124 is missing
    assert p.status.get_date().isoformat() == "2024-01-02T03:04:05+00:00"
    assert rows(p.source("node").data, "id") == [(2,)] and rows(p.source("location").data, "id", "x") == [(1, 8.0), (2, 2.0)]
    assert [(r.id, [(q.x, q.y) for q in r.geom]) for r in p.source("lines").data.collect()] == [(5, [(8.0, 9.0), (2.0, 2.0)])]
    (at / "124.osc.bz2").write_bytes(bz2.compress(b"<osmChange/>"))
    assert replication.catch_up(p, diffs, None, False) == [4600124, 4600125]
    assert rows(p.source("lines").data, "id") == [(5,), (7,)]


def test_sequences_of_names(spark):
    names = ["file:/a/004/600/123.osc.gz", "/x/12.opl", "diff-0017.osc", "/a/000/000/001.osm.bz2", "/2024/b.osc", "/004/12/7.osc"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in df.select(files.sequence_of(F.col("path"))).collect()] == [4600123, 12, 17, 1, None, 7]


def test_blobs_of_other_compressions():
    zstandard = pytest.importorskip("zstandard")
    import lzma

    data = b"abc" * 100
    for number, packed in ((1, data), (3, zlib.compress(data)), (4, lzma.compress(data)), (7, zstandard.compress(data))):
        assert bytes(pbf.inflate(num(2, len(data)) + msg(number, packed))) == data
    with pytest.raises(ValueError):
        pbf.inflate(msg(6, data))


def increments(spark, tmp_path, page=100):
    folder = tmp_path / "in +1%"
    folder.mkdir(exist_ok=True)
    run = IncrementalFolder(spark, f"file://{folder}", f"file://{tmp_path}/state", page)
    process = lambda paths: spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return folder, run, process, lambda: sorted(r.value for r in run.committed("value string").collect())


def test_new_and_changed_files_are_processed_once(spark, tmp_path):
    folder, run, process, values = increments(spark, tmp_path)
    assert run.run(process) == [] and values() == []
    (folder / "a b.txt").write_text("1\n2\n")
    assert run.run(process) == [0] and run.run(process) == []
    (folder / "b.txt").write_text("3\n")

    def fails(paths):
        return process(paths).withColumn("value", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception):
        run.run(fails)
    assert values() == ["1", "2"]
    assert run.run(process) == [1] and values() == ["1", "2", "3"]
    (folder / "a b.txt").write_text("9\n9\n")
    assert [os.path.basename(r.path) for r in run.pending().collect()] == ["a b.txt"]
    assert run.run(process) == [2] and values() == ["3", "9", "9"]
    (folder / "a b.txt").write_text("1\n2\n")  # as it was at first
    assert run.run(process) == [3] and values() == ["1", "2", "3"]
    assert run.run(process) == []


@pytest.mark.parametrize("step", ["output", "manifest", "commit"])
def test_a_failed_run_over_files_is_repeated(spark, tmp_path, monkeypatch, step):
    folder, run, process, values = increments(spark, tmp_path)
    (folder / "a.txt").write_text("1\n")
    write, commit = run.log.write, run.log.commit

    def failing(kind, df):
        write(kind, df)
        if kind == step:
            raise RuntimeError(step)

    def stop():
        raise RuntimeError(step)

    monkeypatch.setattr(run.log, "write", failing)
    monkeypatch.setattr(run.log, "commit", stop if step == "commit" else commit)
    with pytest.raises(RuntimeError):
        run.run(process)
    monkeypatch.undo()
    (folder / "b.txt").write_text("2\n")
    assert values() == [] and run.run(process) == [0] and values() == ["1", "2"]


def test_many_files_make_several_batches(spark, tmp_path):
    folder, run, process, values = increments(spark, tmp_path, 2)
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"{i}\n")
    assert run.run(process) == [0, 1, 2] and values() == list("01234") and run.run(process) == []
