"""Samples of planes for blocks that refer to other frames, and neighbours of cells on a grid.

Planes are stored as tiles with a border, so a block finds all its samples in
one tile: one join on (frame, tile), however large frames are and wherever
vectors point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.cursor import bind

#: Samples of a tile's side, and how many more it has to the right and below: a block of 64, scaled by two, and eight taps.
TILE, BORDER = 64, 136
#: Samples of tiles that a task holds before it passes them on.
HELD = 1 << 20


def _clamped(x: Column, size: Column) -> Column:
    return F.greatest(F.least(x, size - 1), F.lit(0))


def tiles(planes: DataFrame, keys: list[str], samples: str, width: str, height: str, tile: int = TILE, border: int = BORDER) -> DataFrame:
    """(keys, width, height, tile_row, tile_column, samples) of planes, arrays row by row.

    A tile ends where its plane does, so the last ones have fewer rows or
    columns.
    """
    side, names = tile + border, ["tile_row", "tile_column"]
    rows = planes.filter((F.col(width) > 0) & (F.col(height) > 0)).select(*keys, F.col(width).alias("width"), F.col(height).alias("height"), F.col(samples).alias("samples"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plane, held, size = batch.column(len(keys) + 2), [], 0
            wide, high = (batch.column(len(keys) + k).to_pylist() for k in range(2))
            for at, (w, h) in enumerate(zip(wide, high)):
                places = np.arange(w * h).reshape(h, w)
                for i in range(0, h, tile):
                    for j in range(0, w, tile):
                        held.append((at, i // tile, j // tile, places[i : i + side, j : j + side].reshape(-1)))
                        size += len(held[-1][3])
                if size > HELD or at + 1 == len(batch):
                    yield told(batch, plane, held)
                    held, size = [], 0

    def told(batch: pa.RecordBatch, plane: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        owner = np.array([x[0] for x in held])
        counts = np.array([len(x[3]) for x in held])
        have = np.repeat(pc.fill_null(pc.list_value_length(plane), 0).to_numpy(zero_copy_only=False)[owner], counts)
        first, last = int(owner[0]), int(owner[-1]) + 1
        values = plane.slice(first, last - first).flatten()
        sizes = pc.fill_null(pc.list_value_length(plane.slice(first, last - first)), 0).to_numpy(zero_copy_only=False)
        places = np.concatenate([x[3] for x in held])
        at = places + np.repeat((np.cumsum(sizes) - sizes)[owner - first], counts)
        found = values.take(pa.array(at, mask=places >= have))
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), found)
        numbers = [pa.array([x[k] for x in held], pa.int32()) for k in (1, 2)]
        kept = [batch.column(k).take(pa.array(owner)) for k in range(len(keys) + 2)]
        return pa.RecordBatch.from_arrays([*kept, *numbers, cells], [*batch.schema.names[: len(keys) + 2], *names, "samples"])

    kinds = StructType([*rows.schema.fields[:-1], *[StructField(n, IntegerType()) for n in names], rows.schema.fields[-1]])
    return rows.mapInArrow(cut, kinds)


def gather(
    blocks: DataFrame, tiled: DataFrame, keys: list[str], x: Column, y: Column, across: Column, down: Column, step_x: Column | None = None, step_y: Column | None = None,
    tile: int = TILE, border: int = BORDER, sizes: DataFrame | None = None,
) -> DataFrame:
    """``blocks`` with samples: those of their reference plane from (x, y) on, ``across`` by ``down``, row by row.

    x and y count sixteenths of a sample and may lie outside the plane; steps
    are sixteenths as well, 16 for planes of the same size.  Samples outside are
    those of the nearest edge.  A block that reaches farther than a tile's
    border, or has no plane, gets null.  ``sizes`` has (keys, width, height) of
    each plane once; without it they are taken from the tiles.

    Tiles are many times what a plan takes their size for, so both joins are
    merges: no side is held whole by the driver or a task.
    """
    step_x, step_y = (F.lit(16) if s is None else s for s in (step_x, step_y))
    side = tile + border
    if sizes is None:
        sizes = tiled.filter("tile_row = 0 AND tile_column = 0").select(*keys, "width", "height")
    placed = blocks.withColumns({"__x": x.cast("long"), "__y": y.cast("long"), "__w": across, "__h": down, "__sx": step_x, "__sy": step_y}).join(sizes.hint("merge"), keys, "left")
    at = lambda value, size: F.floor(_clamped(F.floor(value / 16), size) / tile).cast("int")
    placed = placed.withColumns({"tile_row": at(F.col("__y"), F.col("height")), "tile_column": at(F.col("__x"), F.col("width"))})
    joined = placed.join(tiled.drop("width", "height").withColumnRenamed("samples", "__tile").hint("merge"), [*keys, "tile_row", "tile_column"], "left")

    def places(value: str, step: str, n: str, size: str, t: str) -> Column:
        place = lambda k: (_clamped(F.floor((F.col(value) + k * F.col(step)) / 16), F.col(size)) - F.col(t) * tile).cast("int")
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)

    def found(p: Column) -> Column:
        inside = F.forall(p["rows"], lambda r: r < side) & F.forall(p["columns"], lambda c: c < side)
        return F.when(inside, F.flatten(F.transform(p["rows"], lambda r: F.transform(p["columns"], lambda c: F.get("__tile", r * p["stride"] + c)))))

    stride = F.least(F.lit(side), F.col("width") - F.col("tile_column") * tile).cast("int")
    lines = F.struct(places("__y", "__sy", "__h", "height", "tile_row").alias("rows"), places("__x", "__sx", "__w", "width", "tile_column").alias("columns"), stride.alias("stride"))
    whole = F.when(F.col("__tile").isNotNull(), bind(bind(lines, found), lambda v: F.when(~F.exists(v, lambda s: s.isNull()), v)))
    return joined.select(*blocks.columns, whole.alias("samples"))


def neighbours(cells: DataFrame, keys: list[str], row: str, column: str, value: Column, offsets: list[tuple[int, int]], left: Column, right: Column, block: int = 8) -> DataFrame:
    """``cells`` with candidates: the values at ``offsets`` (rows, columns) from each, in order, null where there is none.

    Cells are dealt by blocks of ``block`` by ``block``, and those near a
    block's edge go to the blocks beside it too, so that each block finds all
    neighbours in itself and holds no more than its own cells and a margin.
    Cells from ``left`` on and before ``right`` are one tile; a neighbour in
    another one does not count.
    """
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    home = lambda c: F.floor(c / block).cast("long")
    near = lambda c: F.array_distinct(F.array(home(c - reach), home(c), home(c + reach)))
    told = cells.withColumns({"__r": F.col(row).cast("long"), "__c": F.col(column).cast("long"), "__v": value, "__left": left.cast("long"), "__right": right.cast("long")})
    spread = told.withColumn("__br", F.explode(near(F.col("__r")))).withColumn("__bc", F.explode(near(F.col("__c"))))
    own = (home(F.col("__r")) == F.col("__br")) & (home(F.col("__c")) == F.col("__bc"))
    place = F.struct(F.col("__r").alias("r"), F.col("__c").alias("c"))
    entry = F.struct(place.alias("place"), F.struct(F.col("__v").alias("v")).alias("value"))
    local = spread.groupBy(*keys, "__br", "__bc").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("__map"),
        F.collect_list(F.when(own, F.struct(*cells.columns, "__r", "__c", "__left", "__right"))).alias("__own"),
    )
    each = local.select("__map", F.explode("__own").alias("x"))

    def at(a: int, b: int) -> Column:
        found = F.try_element_at("__map", F.struct((F.col("x.__r") + a).alias("r"), (F.col("x.__c") + b).alias("c")))
        return F.when((F.col("x.__c") + b >= F.col("x.__left")) & (F.col("x.__c") + b < F.col("x.__right")), found["v"])

    return each.select(*[F.col(f"x.{c}") for c in cells.columns], F.array(*[at(a, b) for a, b in offsets]).alias("candidates"))
