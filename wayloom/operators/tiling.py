"""Map tiles that a batch of changes touches, and what is to be done with each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.geo import stretch_crosses_box
from wayloom.functions.tiles import HALF_WORLD, tile_box, tile_column, tile_id, tile_path, tile_row
from wayloom.operators.relational import upsert
from wayloom.session import cut


#: By how much, in projected units, a stretch is taken to be longer when tiles are enumerated; the exact test comes after.
SLACK = 1e-3


def _stretches(lines: DataFrame) -> DataFrame:
    """(a, b): the single stretches of the lines (geom, projected)."""
    stretch = F.transform(F.sequence(F.lit(0), F.size("geom") - 2), lambda i: F.struct(F.get("geom", i).alias("a"), F.get("geom", i + 1).alias("b")))
    return lines.where(F.size("geom") > 1).select(F.inline(stretch))


def _cells(stretches: DataFrame, zoom: int) -> DataFrame:
    """(a, b, x, y): the tiles at a zoom that each stretch crosses.

    A stretch goes through its tile columns one by one; what of it lies within a column says in which
    rows. So the work follows the tiles crossed, not the box around a stretch.
    """
    z = F.lit(zoom)
    width = 2 * HALF_WORLD / 2**zoom
    a, b = F.col("a"), F.col("b")
    least, most = F.least(a["x"], b["x"]) - SLACK, F.greatest(a["x"], b["x"]) + SLACK
    columns = stretches.select("a", "b", F.explode(F.sequence(tile_column(least, z), tile_column(most, z))).alias("x"))
    left, d = F.col("x") * width - HALF_WORLD - SLACK, b["x"] - a["x"]
    enter, leave = (left - a["x"]) / F.nullif(d, F.lit(0.0)), (left + width + 2 * SLACK - a["x"]) / F.nullif(d, F.lit(0.0))
    first = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), enter, leave)), F.lit(0.0))
    last = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), enter, leave)), F.lit(1.0))
    y = lambda t: a["y"] + t * (b["y"] - a["y"])
    part = columns.select("a", "b", "x", y(first).alias("u"), y(last).alias("v"))
    rows = F.sequence(tile_row(F.greatest("u", "v") + SLACK, z), tile_row(F.least("u", "v") - SLACK, z))
    box = tile_box(z, F.col("x"), F.col("y"))
    return part.select("a", "b", "x", F.explode(rows).alias("y")).where(stretch_crosses_box(a, b, box["x0"], box["y0"], box["x1"], box["y1"]))


def touched_tiles(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct (zoom, x, y) of the tiles that the lines (geom, projected) cross, from zoom first to last.

    A tile that is crossed has a child that is, so the upper tiles are the ancestors of those at the last zoom.
    """
    return _upwards(_cells(_stretches(lines), last), first, last)


def _upwards(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct (zoom, x, y) of the tiles at zoom last and those above them."""
    up = F.explode(F.sequence(F.lit(0), F.lit(last - first)))
    deepest = cells.select("x", "y").distinct().select("x", "y", up.alias("up"))
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("up"))
    return deepest.select((F.lit(last) - F.col("up")).alias("zoom"), shift("x").alias("x"), shift("y").alias("y")).distinct()


def plan_tiles(data: DataFrame, change: DataFrame | None, first: int, last: int, prerender: int) -> DataFrame:
    """(id, zoom, x, y, task): render up to zoom prerender, reserve beyond, delete where no data is left.

    Without changes every tile with data is planned. change: the changed lines, old and new; below the
    middle zoom, only what data has in the tiles that they touch there is looked for.
    """
    if change is None or last == first:
        there = touched_tiles(data, first, last)
    else:
        touched, middle = cut(touched_tiles(change, first, last)), (first + last) // 2
        half = cut(_cells(_stretches(data), middle))
        near = half.join(touched.where(F.col("zoom") == middle).select("x", "y"), ["x", "y"], "left_semi").select("a", "b")
        lower = _upwards(_cells(near, last), middle + 1, last)
        there = _upwards(half, first, middle).unionByName(lower)
    full = there.withColumn("data", F.lit(True))
    if change is not None:
        full = (touched_tiles(change, first, last) if last == first else touched).join(full, ["zoom", "x", "y"], "left")
    task = F.when(F.col("data").isNull(), "delete").when(F.col("zoom") <= prerender, "render").otherwise("reserve")
    return full.select(tile_id(F.col("zoom"), F.col("x"), F.col("y")).alias("id"), "zoom", "x", "y", task.alias("task"))


def apply_plan(store: DataFrame, plan: DataFrame, rendered: DataFrame) -> DataFrame:
    """A tile store (id, pixbuf) after a plan: rendered tiles are put in, reserved ones without a picture, deleted ones go."""
    rows = plan.where("task != 'delete'").join(rendered, "id", "left").select(
        "id", F.when(F.col("task") == "render", F.col("pixbuf")).alias("pixbuf")
    )
    return upsert(store.join(plan.select("id"), "id", "left_anti"), rows)


def find_tiles(store: DataFrame, asked: DataFrame, deepest: int) -> DataFrame:
    """asked (zoom, x, y, any other columns) with state and pixbuf, from a tile store (id, pixbuf) that goes down to zoom deepest.

    state: stored, with the picture; render, if the tile has none yet, or, below the store, if its
    ancestor at zoom deepest is in it; else empty.
    """
    over = F.greatest(F.col("zoom") - deepest, F.lit(0))
    up = lambda c: F.call_function("shiftright", F.col(c).cast("long"), over.cast("int"))
    wanted = asked.withColumn("__id", tile_id(F.least(F.col("zoom"), F.lit(deepest)), up("x"), up("y")))
    held = store.select(F.col("id").alias("__id"), "pixbuf", F.lit(True).alias("__held"))
    own = F.col("__held") & (over == 0) & F.col("pixbuf").isNotNull()
    state = F.when(own, "stored").when(F.col("__held"), "render").otherwise("empty")
    return wanted.join(held, "__id", "left").select(*asked.columns, state.alias("state"), F.when(own, F.col("pixbuf")).alias("pixbuf"))


def fill_tiles(store: DataFrame, rendered: DataFrame) -> DataFrame:
    """The store after pictures (id, pixbuf) were made for tiles that it has without one; others are left as they are."""
    new = rendered.select("id", F.col("pixbuf").alias("__new"))
    return store.join(new, "id", "left").select("id", F.coalesce("pixbuf", "__new").alias("pixbuf"))


def write_tiles(pictures: DataFrame, folder: str, split: bool = True) -> DataFrame:
    """(path) of the files written for pictures (zoom, x, y, pixbuf) by the tasks; a null picture is an empty file. The result must be acted on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for part in parts:
            for path, picture in zip(part["path"], part["pixbuf"]):
                name = f"{root}/{path}"
                where.create_dir(name.rpartition("/")[0], recursive=True)
                with where.open_output_stream(name) as f:
                    f.write(picture or b"")
            yield part[["path"]]

    path = tile_path(F.col("zoom"), F.col("x"), F.col("y"), split)
    return pictures.select(path.alias("path"), "pixbuf").mapInPandas(run, "path string")
