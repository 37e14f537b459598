"""Points near other points, or in regions: cells on a space-filling curve, ranges of cells, exact tests.

For distances, the earth is cut into rows as high as the radius and each row into cells at least as
wide, so that cells stay square up to the poles and meet across the date line. A cell's code
interleaves the bits of its row and column (Z order). The disc around a point is covered by cells,
adjacent codes are joined to ranges, and a range is cut at blocks of the curve. For regions, cells are
those of a quadtree over longitude and latitude, on a level that suits the region's size.

Points and ranges come out of one pass and are shuffled together by block. In a task they are sorted by
code, and a range meets the run of codes between its ends, which two binary searches find; the distance
or the region's border decides. Blocks with more rows than HOT are put aside in that pass and joined in
a second one, both sides salted, so that no task holds more than a few times HOT rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.session import cut

EARTH_M = 6_371_008.8
#: Bits of the code below a block: 4 x 4 cells for discs, 8 x 8 for regions.
BLOCK_BITS, REGION_BITS = 4, 6
#: Rows of a block that one task holds; blocks with more are salted.
HOT = 200_000
#: Pairs of a point and a range that are tested together.
TESTED = 1_000_000
#: Levels of the quadtree, and cells of a region's level that its box may span.
LEVELS, COVER = 26, 64


def _spread(v: np.ndarray) -> np.ndarray:
    """Puts a zero before each of the low 31 bits."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def curve_code(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return ((_spread(row) << np.uint64(1)) | _spread(col)).astype(np.int64)


class Grid:
    """Cells of at least radius_m on each side."""

    def __init__(self, radius_m: float):
        self.reach = np.degrees(radius_m / EARTH_M) * (1 + 1e-6)
        self.rows = max(1, int(180 / self.reach))
        self.height = 180 / self.rows

    def columns(self, row: np.ndarray) -> np.ndarray:
        """Cells of a row, by its edge nearer to a pole."""
        edge = np.maximum(np.abs(row * self.height - 90), np.abs((row + 1) * self.height - 90))
        return np.maximum(1, np.floor(360 * np.cos(np.radians(np.minimum(edge, 90))) / self.reach)).astype(np.int64)

    def row(self, lat: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((lat + 90) / self.height), 0, self.rows - 1).astype(np.int64)

    def code(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        row = self.row(lat)
        n = self.columns(row)
        return curve_code(row, np.floor((lon + 180) / 360 * n).astype(np.int64) % n)

    def cover(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, code) of every cell that its disc may touch."""
        own, at, codes = self.row(lat), [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = np.degrees(np.arcsin(np.sin(np.radians(self.reach)) / np.cos(np.radians(lat)))) * (1 + 1e-6)
        wide = np.where((np.abs(lat) + self.reach >= 90) | ~np.isfinite(wide), 180.0, wide)
        for step in (-1, 0, 1):
            row = own + step
            keep = np.flatnonzero((row >= self.row(lat - self.reach)) & (row <= self.row(lat + self.reach)))
            r, n = row[keep], self.columns(row[keep])
            first = np.floor((lon[keep] - wide[keep] + 180) / 360 * n).astype(np.int64)
            many = np.minimum(np.floor((lon[keep] + wide[keep] + 180) / 360 * n).astype(np.int64) - first + 1, n)
            for k in range(int(many.max(initial=0))):
                some = many > k
                at.append(keep[some])
                codes.append(curve_code(r[some], (first[some] + k) % n[some]))
        return np.concatenate(at), np.concatenate(codes)


def _ranges(at: np.ndarray, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges (point, block, lo, hi) of the codes not below the point's own: each pair is met once."""
    keep = codes >= own[at]
    at, codes = at[keep], codes[keep]
    order = np.lexsort((codes, at))
    at, codes = at[order], codes[order]
    again = np.r_[False, (at[1:] == at[:-1]) & (codes[1:] == codes[:-1])]
    at, codes = at[~again], codes[~again]
    block = codes >> BLOCK_BITS
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (codes[1:] != codes[:-1] + 1) | (block[1:] != block[:-1])])
    ends = np.r_[starts[1:], len(codes)] - 1
    return at[starts], block[starts], codes[starts], codes[ends]


#: Rows that are shuffled: a point or a range of codes from lo on; mark has the kind in its low three bits and how many codes follow lo.
_TAGGED = "lo bigint, mark int, id bigint, x double, y double"
_NAMES = ["lo", "mark", "id", "x", "y"]
#: Kinds of rows: a point, with a radius also the range that begins with its own code; a range; a range within
#: a region; of a salted point, the point alone and that range alone.
_POINT, _RANGE, _INSIDE, _STILL, _ASKING = 0, 1, 2, 3, 4


def _rows(*parts: tuple) -> pa.RecordBatch:
    """One batch of tagged rows from parts (lo, kind, codes that follow, id, x, y)."""
    join = lambda i: np.concatenate([np.broadcast_to(p[i], len(p[0])) for p in parts])
    mark = (join(1) | join(2) << 3).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (join(0), mark, join(3), join(4), join(5))], _NAMES)


def encode(points: DataFrame, radius_m: float) -> DataFrame:
    """Tagged rows of points (id, x, y): each at its code, and the other ranges that cover its disc. One pass over Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(radius_m)
        for b in batches:
            if not b.num_rows:
                continue
            i, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y"))
            own = grid.code(x, y)
            at, block, lo, hi = _ranges(*grid.cover(x, y), own)
            first = lo == own[at]
            follow = np.zeros(len(i), np.int64)
            follow[at[first]] = (hi - lo)[first]
            at, lo, hi = at[~first], lo[~first], hi[~first]
            yield _rows((own, _POINT, follow, i, x, y), (lo, _RANGE, hi - lo, i[at], x[at], y[at]))

    return points.select("id", "x", "y").mapInArrow(run, _TAGGED)


def _near(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, radius_m: float) -> np.ndarray:
    """Whether two places lie at most radius_m apart on the sphere (haversine)."""
    h = np.sin(np.radians(y2 - y1) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return h <= np.sin(radius_m / EARTH_M / 2) ** 2


def _range_join(columns: list[np.ndarray], radius_m: float | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(id of a range's row, id of a point, kind of the range, place of the point) of rows sorted by code. With a radius, only those within it."""
    lo, mark, ids, x, y = columns
    kind, follow = mark & 7, (mark >> 3).astype(np.int64)
    own = (kind == _POINT) | (kind == _ASKING)
    p = np.flatnonzero((kind == _POINT) | (kind == _STILL))
    r = np.flatnonzero(kind != (_POINT if radius_m is None else _STILL))
    codes = lo[p]
    first = np.searchsorted(codes, lo[r])
    many = np.searchsorted(codes, lo[r] + follow[r], "right") - first
    ends = np.cumsum(many)
    at = 0
    while at < len(r):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TESTED, "right")))
        n = many[at:to]
        a = np.repeat(r[at:to], n)
        b = p[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)]
        at = to
        if radius_m is not None:
            hit = ~own[a] | (lo[b] != lo[a]) | (ids[b] > ids[a])
            a, b = a[hit], b[hit]
            hit = _near(x[a], y[a], x[b], y[b], radius_m)
            a, b = a[hit], b[hit]
        if len(a):
            yield ids[a], ids[b], kind[a], x[b], y[b]


def _joined(tagged: DataFrame, bits: int, radius_m: float | None) -> DataFrame:
    """(a, b, kind, x, y): the matches of ranges and points of tagged rows, with the place of the point. No range goes beyond its block."""

    def task(hot: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] | None = None
            aside: int | None = None

            def matches(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                for a, b, kind, x, y in _range_join(columns, radius_m):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind), pa.nulls(len(a), pa.int64()), pa.array(x), pa.array(y)], _OUT_NAMES)

            def put_aside(columns: list[np.ndarray]) -> pa.RecordBatch:
                lo, mark, ids, x, y = columns
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(mark), pa.array(lo), pa.array(x), pa.array(y)], _OUT_NAMES)

            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if aside is not None:
                    n = int(np.searchsorted(columns[0] >> bits, aside, "right"))
                    if n:
                        yield put_aside([c[:n] for c in columns])
                        columns = [c[n:] for c in columns]
                if held is not None and len(held[0]):
                    columns = [np.concatenate(p) for p in zip(held, columns)]
                if not len(columns[0]):
                    continue
                last = int(np.searchsorted(columns[0], columns[0][-1] >> bits << bits))
                yield from matches([c[:last] for c in columns])
                held = [c[last:] for c in columns]
                if hot is not None and len(held[0]) > hot:
                    aside = int(held[0][0]) >> bits
                    yield put_aside(held)
                    held = None
            if held is not None:
                yield from matches(held)

        return run

    block = F.shiftright("lo", bits)
    by = lambda df, hot: df.repartition(block).sortWithinPartitions("lo").select(*_NAMES).mapInArrow(task(hot), _OUT)
    found = ["a", "b", "kind", "x", "y"]
    first = cut(by(tagged, HOT))
    done = first.where("b IS NOT NULL").select(*found)
    hot = first.where("b IS NULL").select("lo", F.col("kind").alias("mark"), F.col("a").alias("id"), "x", "y")
    if hot.isEmpty():
        return done
    hot = hot.withColumn("block", block)
    salts = hot.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT)).cast("int").alias("salts"))
    own, every = F.pmod(F.xxhash64("id"), F.col("salts")), F.sequence(F.lit(0), F.col("salts") - 1).cast("array<bigint>")
    salted, kind = hot.join(salts, "block"), F.col("mark").bitwiseAND(7)
    points, asking = salted.where(kind == _POINT), salted if radius_m is not None else salted.where(kind != _POINT)
    alone = F.when(kind == _POINT, F.col("mark") + _ASKING).otherwise(F.col("mark"))
    points = points.withColumn("s", own).withColumn("t", F.explode(every)).withColumn("mark", F.lit(_POINT if radius_m is None else _STILL))
    asking = asking.withColumn("t", own).withColumn("s", F.explode(every)).withColumn("mark", alone)
    low = F.col("lo").bitwiseAND((1 << bits) - 1)
    split = points.unionByName(asking).withColumn("lo", F.shiftleft(F.xxhash64("block", "s", "t"), bits).bitwiseOR(low))
    return done.unionByName(by(split, None).select(*found))


_OUT = "a bigint, b bigint, kind int, lo bigint, x double, y double"
_OUT_NAMES = ["a", "b", "kind", "lo", "x", "y"]


def usable_places(df: DataFrame) -> DataFrame:
    """Rows with an id and a place on earth: x and y not null, no NaN, in range, and not 0/0, which stands for unknown."""
    x, y = F.col("x"), F.col("y")
    return df.where(F.col("id").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & x.between(-180, 180) & y.between(-90, 90) & ~((x == 0) & (y == 0)))


def near_places(points: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different places at most radius_m apart, and members (place, id), for points (id, x, y; one row an id).

    A place is named by the least id at it; members has the rows of all places with more than one. So a
    crowd at one place is one row of the join, and its members need not be paired.
    """
    ok = usable_places(points).select("id", "x", "y")
    places = ok.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    pairs = _joined(encode(places, radius_m), BLOCK_BITS, radius_m).select("a", "b")
    shared = places.where("n > 1").select("x", "y", F.col("id").alias("place"))
    return pairs, ok.join(shared, ["x", "y"]).select("place", "id")


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(node_a, node_b), node_a < node_b, of points (id, x, y; one row an id) at most radius_m apart.

    Points at the same place are pairs too. Rows without a usable place, with a null id, and NaN
    are left out; an empty table gives an empty result. The pairs are the result, so a crowded
    place costs what it returns here; near_places gives the same without the pairs of crowds.
    """
    pairs = _joined(encode(usable_places(points), radius_m), BLOCK_BITS, radius_m)
    return pairs.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"))


# Regions


def _quad(lon: np.ndarray, lat: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column in the quadtree's cells of a level."""
    n = 1 << level
    part = lambda v, low, span: np.clip(np.floor((v - low) / span * n), 0, n - 1).astype(np.int64)
    return part(lat, -90, 180), part(lon, -180, 360)


def _levelled(level: int, code: np.ndarray) -> np.ndarray:
    """Codes of different levels are different codes, and lie in different blocks."""
    return code | (level << 56)


def cover_region(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(level, lo, hi, inside): ranges of cells that cover a ring; inside: all of the range lies within it.

    The level is the finest on which the ring's box spans at most COVER cells.
    """
    for level in range(LEVELS, -1, -1):
        (r0, r1), (c0, c1) = _quad(np.array([x.min(), x.max()]), np.array([y.min(), y.max()]), level)
        if (r1 - r0 + 1) * (c1 - c0 + 1) <= COVER:
            break
    rows, cols = (v.ravel() for v in np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij"))
    w, h = 360 / (1 << level), 180 / (1 << level)
    left, low = cols * w - 180, rows * h - 90
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    grow = 1e-9  # cells count as crossed a little beyond their border, so that rounding makes none of them inside
    enter, leave = np.zeros((len(rows), len(x))), np.ones((len(rows), len(x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, d, edge, size in ((x, x2 - x, left, w), (y, y2 - y, low, h)):
            s, t = (edge[:, None] - grow - p) / d, (edge[:, None] + size + grow - p) / d
            flat = (d == 0)[None, :]
            out = (p < edge[:, None] - grow) | (p > edge[:, None] + size + grow)
            enter = np.maximum(enter, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(s, t)))
            leave = np.minimum(leave, np.where(flat, 1.0, np.maximum(s, t)))
        crossed = (enter <= leave).any(1)
        mx, my = left + w / 2, low + h / 2
        turn = (y > my[:, None]) != (y2 > my[:, None])
        within = (turn & (mx[:, None] < (x2 - x) * (my[:, None] - y) / (y2 - y) + x)).sum(1) % 2 == 1
    keep = crossed | within
    code, inside = curve_code(rows[keep], cols[keep]), ~crossed[keep]
    order = np.argsort(code)
    code, inside = code[order], inside[order]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1] + 1) | (inside[1:] != inside[:-1]) | (code[1:] >> REGION_BITS != code[:-1] >> REGION_BITS)])
    ends = np.r_[starts[1:], len(code)] - 1
    return level, code[starts], code[ends], inside[starts]


def within_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of points, closed or not): a ray to the east crosses an odd number of its edges."""
    ahead = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))

    def crosses(a: Column, b: Column) -> Column:
        turn = (a["y"] > y) != (b["y"] > y)
        return F.when(turn & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, ahead, crosses), F.lit(0), lambda n, c: n + c) % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, point) for points (id, x, y) and regions (id, ring: array of points x, y), one row an id each.

    A region is the inside of its ring on the plane of longitude and latitude; the ring is closed by
    itself. Points without a usable place, rings of fewer than three points or with nulls, and null ids
    have no rows. The levels in use, at most LEVELS + 1 small numbers, come to the driver.
    """
    whole = F.size("ring") >= 3
    whole = whole & ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    regions = regions.where(F.col("id").isNotNull() & whole).select("id", "ring")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, ring in zip(b.column("id").to_pylist(), b.column("ring").to_pylist()):
                x, y = (np.array([p[c] for p in ring]) for c in "xy")
                level, lo, hi, inside = cover_region(x, y)
                none = np.zeros(len(lo))
                parts.append((_levelled(level, lo), np.where(inside, _INSIDE, _RANGE), hi - lo, np.full(len(lo), i), none, none))
            if parts:
                yield _rows(*parts)

    ranges = cut(regions.mapInArrow(cover, _TAGGED))
    levels = sorted(r[0] for r in ranges.select(F.shiftright("lo", 56)).distinct().collect())
    if not levels:
        return regions.sparkSession.createDataFrame([], "region bigint, point bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                row, col = _quad(x, y, LEVELS)
                code = curve_code(row, col)
                up = [code >> 2 * (LEVELS - k) for k in levels]
                yield _rows(*((_levelled(k, c), _POINT, 0, i, x, y) for k, c in zip(levels, up)))

    places = usable_places(points).select("id", "x", "y")
    block = F.shiftright("lo", REGION_BITS).alias("block")
    blocks = ranges.select(block).distinct()
    tagged = places.mapInArrow(place, _TAGGED).withColumn("block", block).join(blocks, "block", "left_semi").select(*_NAMES).unionByName(ranges)
    met = cut(_joined(tagged, REGION_BITS, None).select(F.col("a").alias("region"), F.col("b").alias("point"), "kind", "x", "y"))
    asked = met.where(F.col("kind") != _INSIDE).join(regions.withColumnRenamed("id", "region"), "region")
    sure = asked.where(within_ring(F.col("x"), F.col("y"), F.col("ring")))
    return met.where(F.col("kind") == _INSIDE).select("region", "point").unionByName(sure.select("region", "point"))
