"""Frame geometry and media time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def i420_bytes(w: Column, h: Column) -> Column:
    """Bytes of a compact 4:2:0 picture."""
    return w * h + 2 * F.floor((w + 1) / 2) * F.floor((h + 1) / 2)


def mi_units(size: Column) -> Column:
    """Units of 8 samples that cover ``size``."""
    return F.floor((size + 7) / 8)


def superblocks(size: Column) -> Column:
    return F.floor((size + 63) / 64)


def tile_offset(n: Column, units: Column, log2: Column) -> Column:
    """Where tile ``n`` of 2**log2 begins, in units of 8 samples."""
    blocks = F.floor((units + 7) / 8)
    return F.least(F.floor(n * blocks / F.pow(F.lit(2), log2)).cast("long") * 8, units)


def tile_log2_bounds(width: Column) -> tuple[Column, Column]:
    """Least and greatest log2 of tile columns: a tile has 4 to 64 superblocks across."""
    blocks = superblocks(width)
    least = F.when(blocks <= 64, 0).otherwise(F.ceil(F.log2(blocks / 64)))
    most = F.greatest(F.floor(F.log2(F.greatest(F.floor(blocks / 4), F.lit(1)))), F.lit(0))
    return least.cast("int"), most.cast("int")


def micros_of_ticks(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """Microseconds, halves towards plus infinity."""
    return F.floor(ticks * 1000000.0 * numerator / denominator + 0.5).cast("long")


def reference_fits(w: Column, h: Column, references: Column) -> Column:
    """Whether any of the references, an array of (w, h), can be scaled to (w, h)."""
    fits = lambda r: (2 * w >= r["w"]) & (2 * h >= r["h"]) & (w <= 16 * r["w"]) & (h <= 16 * r["h"])
    return F.exists(references, fits)


def plane_bounds(w: Column, h: Column) -> Column:
    """Where the three planes of a compact 4:2:0 picture start and end, in bytes."""
    luma, chroma = w * h, F.floor((w + 1) / 2) * F.floor((h + 1) / 2)
    return F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")) for a, b in ((F.lit(0), luma), (luma, luma + chroma), (luma + chroma, luma + 2 * chroma))])


def compact_plane(samples: Column, stride: int, width: int, height: int) -> Column:
    """The visible samples of a plane (BINARY) whose rows are ``stride`` bytes apart."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.hex(F.substring(samples, r * stride + 1, F.lit(width))))
    return F.unhex(F.array_join(rows, ""))
