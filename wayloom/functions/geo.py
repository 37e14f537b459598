"""Expressions over points and lines. A line is an array of points (x, y)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.model import LINE

#: By how much a point is moved that lies where the one before it lies.
NUDGE = 1e-8
MERCATOR_RADIUS = 6_378_137.0
WKB_POINT, EWKB_SRID = 1, 0x20000000


def nudged(points: Column) -> Column:
    """The line of an array of points; nulls are skipped, and a point equal to the one put out before is moved in x."""

    def step(line: Column, p: Column) -> Column:
        last = F.try_element_at(line, F.lit(-1))
        same = (last["x"] == p["x"]) & (last["y"] == p["y"])
        moved = F.struct((p["x"] + F.lit(NUDGE)).alias("x"), p["y"].alias("y"))
        return F.concat(line, F.array(F.when(F.coalesce(same, F.lit(False)), moved).otherwise(p)))

    there = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.aggregate(there, F.array().cast(LINE), step)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS


def to_mercator(line: Column) -> Column:
    """A line in degrees as metres of the spherical Mercator projection."""
    return F.transform(line, lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y")))


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def ewkb_point(x: Column, y: Column, srid: int = 4326) -> Column:
    """A point as extended WKB in hex, little-endian; null if a coordinate is."""

    @F.pandas_udf("string")
    def pack(xs: pd.Series, ys: pd.Series) -> pd.Series:
        head = struct.pack("<BII", 1, WKB_POINT | EWKB_SRID, srid).hex()
        places = np.column_stack([xs.to_numpy("float64"), ys.to_numpy("float64")])
        digits = places.astype("<f8").tobytes().hex()
        null = np.isnan(places).any(1).tolist()
        return pd.Series([None if n else head + digits[32 * i : 32 * i + 32] for i, n in enumerate(null)], dtype=object)

    return pack(x, y)


def point_of_ewkb(geom: Column) -> Column:
    """The point (x, y) of an EWKB or WKB point in binary; null for anything else."""

    @F.pandas_udf("struct<x:double,y:double>")
    def unpack(blobs: pd.Series) -> pd.DataFrame:
        known = blobs.notna().to_numpy()
        size = np.zeros(len(blobs), np.int64)
        size[known] = [len(b) for b in blobs[known]]
        out = np.full((len(blobs), 2), np.nan)
        for n in np.unique(size[size >= 21]):  # those of one size are read together
            at = np.flatnonzero(size == n)
            raw = np.frombuffer(b"".join(blobs.iloc[at]), np.uint8).reshape(len(at), n)
            for order, first in (("<", raw[:, 0] == 1), (">", raw[:, 0] != 1)):
                kind = raw[:, 1:5].copy().view(order + "u4")[:, 0]
                for skip, own in ((9, kind & EWKB_SRID != 0), (5, kind & EWKB_SRID == 0)):
                    some = first & own & (kind & 0xFF == WKB_POINT)
                    if some.any() and n >= skip + 16:
                        out[at[some]] = raw[some, skip : skip + 16].copy().view(order + "f8")
        return pd.DataFrame(out, columns=["x", "y"]).astype(object).where(~np.isnan(out), None)

    return unpack(geom)


def stretch_crosses_box(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the straight line between two points touches a box: some part of it is left after clipping at the four sides."""

    def clip(lo: Column, hi: Column, p: Column, d: Column) -> tuple[Column, Column]:
        s, t = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= lo) & (p <= hi)
        begin = F.when(d != 0, F.least(s, t)).when(inside, 0.0).otherwise(2.0)
        end = F.when(d != 0, F.greatest(s, t)).when(inside, 1.0).otherwise(-1.0)
        return begin, end

    fx, tx = clip(x0, x1, a["x"], b["x"] - a["x"])
    fy, ty = clip(y0, y1, a["y"], b["y"] - a["y"])
    return F.greatest(F.lit(0.0), fx, fy) <= F.least(F.lit(1.0), tx, ty)


def crosses_box(line: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a line of two points and more touches a box."""
    rest = F.slice(line, F.lit(2), F.size(line))
    pairs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), rest, lambda a, b: stretch_crosses_box(a, b, x0, y0, x1, y1))
    return F.when(F.size(line) > 1, F.exists(pairs, lambda p: p)).otherwise(F.lit(False))
