"""Arithmetic of map tiles in the spherical Mercator projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: half the width of the projected world
HALF_WORLD = 20037508.34


def tile_box(zoom: Column, x: Column, y: Column) -> Column:
    """(x0, y0, x1, y1) of a tile; rows count from the top."""
    width = F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), zoom)
    return F.struct(
        (x * width - HALF_WORLD).alias("x0"), (F.lit(HALF_WORLD) - (y + 1) * width).alias("y0"),
        ((x + 1) * width - HALF_WORLD).alias("x1"), (F.lit(HALF_WORLD) - y * width).alias("y1"),
    )


def tile_id(zoom: Column, x: Column, y: Column) -> Column:
    """Zoom in the low five bits, then x, then y with as many bits as the zoom has."""
    by = F.call_function("shiftleft", y.cast("long"), (zoom + 5).cast("int"))
    return zoom.cast("long") + F.shiftleft(x.cast("long"), 5) + by


def tile_column(mx: Column, zoom: Column) -> Column:
    """Column of the tile that a projected x lies in, kept within the world."""
    n = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((mx + HALF_WORLD) / (2 * HALF_WORLD) * n))).cast("long")


def tile_row(my: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((F.lit(HALF_WORLD) - my) / (2 * HALF_WORLD) * n))).cast("long")


def tile_path(zoom: Column, x: Column, y: Column, split: bool) -> Column:
    """Path of a tile's file. split: from zoom 10 on, a number is cut after its third digit, below 1000 it is followed by ``o``."""

    def parts(n: Column) -> Column:
        text = n.cast("string")
        cut = F.concat_ws("/", F.substr(text, F.lit(1), F.lit(3)), F.substr(text, F.lit(4)))
        return F.when(n < 1000, F.concat(text, F.lit("/o"))).otherwise(cut)

    whole = F.concat_ws("/", zoom.cast("string"), x.cast("string"), y.cast("string"))
    deep = F.concat_ws("/", zoom.cast("string"), parts(x), parts(y))
    return F.concat(F.when(F.lit(split) & (zoom >= 10), deep).otherwise(whole), F.lit(".png"))


def ancestor(n: Column, levels: int) -> Column:
    """Number of the tile that holds tile n some levels up."""
    return F.shiftright(n, levels)
