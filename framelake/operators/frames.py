"""Frames of a stream: headers, tiles, outputs, limits, and how errors and counts of workers are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits, cursor, geometry
from . import scan


def frame_rows(packets: DataFrame, frames: Column) -> DataFrame:
    """One row for each coded frame of ``frames``, an array of (start, len): frame_in_packet, start, len, data."""
    rows = packets.select("*", F.posexplode(frames).alias("frame_in_packet", "__f"))
    data = F.substring(F.col("payload"), (F.col("__f.start") + 1).cast("int"), F.col("__f.len").cast("int"))
    return rows.select(*packets.columns, "frame_in_packet", F.col("__f.start").alias("start"), F.col("__f.len").alias("len"), data.alias("data")).drop("payload")


def key_header(data: Column) -> Column:
    """Struct of the fields at fixed places of a frame's header, and an error.

    A key frame's header hangs on no frame before it: profile, show_existing,
    shown, resilient, width, height, render_width, render_height, and ``end``,
    the bit after them.  For other frames the sizes are null.  error is
    ``invalid`` or ``unsupported``.
    """
    bit = lambda at, n=1: bits.field(data, at, n)
    profile = 2 * bit(3) + bit(2)
    existing = bit(4) == 1
    key = ~existing & (bit(5) == 0)
    sync = bit(8, 24) == 0x498342
    colour = bit(32, 3)
    explicit = bit(68) == 1
    width, height = bit(36, 16) + 1, bit(52, 16) + 1
    error = (
        F.when(F.octet_length(data) < 1, "invalid")
        .when(bit(0, 2) != 2, "invalid")
        .when(profile.isin(1, 3), "unsupported")
        .when((profile == 2) & (existing | key), "unsupported")
        .when(key & (~F.coalesce(sync, F.lit(False)) | F.coalesce(colour == 7, F.lit(True)) | bit(68).isNull() | (explicit & bit(85, 16).isNull())), "invalid")
    )
    of_key = lambda x: F.when(key, x)
    return F.struct(
        profile.alias("profile"),
        existing.alias("show_existing"),
        F.when(existing, bit(5, 3)).alias("existing_slot"),
        key.alias("key"),
        (existing | (bit(6) == 1)).alias("shown"),
        F.when(~existing, bit(7) == 1).alias("resilient"),
        of_key(width).alias("width"),
        of_key(height).alias("height"),
        of_key(F.when(explicit, bit(69, 16) + 1).otherwise(width)).alias("render_width"),
        of_key(F.when(explicit, bit(85, 16) + 1).otherwise(height)).alias("render_height"),
        of_key(F.when(explicit, 101).otherwise(69)).alias("end"),
        error.alias("error"),
    )


#: Fields of a header after its sizes; what filter deltas and probabilities are where nothing is written.
_FILTER = [cursor.Field(f"ref_{k}", 6, True, True, "delta_update", d) for k, d in enumerate((1, 0, -1, -1))] + [cursor.Field(f"mode_{k}", 6, True, True, "delta_update") for k in range(2)]
_PROBABILITIES = [cursor.Field(f"tree_{k}", 8, optional=True, when="update_map", default=255) for k in range(7)]
_PROBABILITIES += [cursor.Field("temporal", 1, when="update_map"), *[cursor.Field(f"pred_{k}", 8, optional=True, when="temporal", default=255) for k in range(3)]]
_FEATURES = [(f"{s}_{k}", bits, k < 2) for s in range(8) for k, bits in enumerate((8, 6, 2, 0))]
_SEGMENTS = [f for name, bits, signed in _FEATURES for f in (cursor.Field(f"on_{name}", 1, when="update_data"), cursor.Field(f"value_{name}", bits, signed, when=f"on_{name}"))]
LAYOUT = [
    cursor.Field("refresh_context", 1, when="plain"), cursor.Field("parallel", 1, when="plain", default=1), cursor.Field("context", 2),
    cursor.Field("level", 6), cursor.Field("sharpness", 3), cursor.Field("deltas", 1), cursor.Field("delta_update", 1, when="deltas"), *_FILTER,
    cursor.Field("base_q", 8), *[cursor.Field(name, 4, True, True) for name in ("y_dc", "uv_dc", "uv_ac")],
    cursor.Field("segmented", 1), cursor.Field("update_map", 1, when="segmented"), *_PROBABILITIES,
    cursor.Field("update_data", 1, when="segmented"), cursor.Field("absolute", 1, when="update_data"), *_SEGMENTS,
]
_TAIL = [cursor.Field("rows_1", 1), cursor.Field("rows_2", 1, when="rows_1"), cursor.Field("compressed_size", 16)]
#: Bytes that hold any such header.
_HEADER_BYTES = 192


def key_fields(data: Column, header: Column) -> Column:
    """Struct of a key frame's fields after its sizes, by its :func:`key_header`; null for other frames.

    refresh_context, parallel, context, level, sharpness, ref_deltas, mode_deltas,
    base_q, y_dc, uv_dc, uv_ac, lossless, segmented, update_map, temporal,
    tree_probabilities, pred_probabilities, absolute, enabled and features (by
    segment, then kind), tile_columns_log2, tile_rows_log2, compressed_size,
    compressed_at, tiles_at, error.
    """
    known = ["plain"]

    def fields(raw: Column, h: Column) -> Column:
        least, most = geometry.tile_log2_bounds(h["width"])
        bounds = F.struct(least.alias("least"), most.alias("most"))
        first = cursor.read(raw, h["end"], LAYOUT, {"plain": (~h["resilient"]).cast("long")})

        def tiles(t: Column, a: Column) -> Column:
            return cursor.bind(cursor.ones(raw, a["at"], t["most"] - t["least"]), lambda b: cursor.bind(cursor.read(raw, b["at"], _TAIL, {}), lambda c: told(raw, t["least"], a, b, c)))

        return cursor.bind(bounds, lambda t: cursor.bind(first, lambda a: tiles(t, a)))

    def told(raw: Column, least: Column, a: Column, b: Column, c: Column) -> Column:
        v, tail = cursor.Values(a, LAYOUT, known), cursor.Values(c, _TAIL)
        features = v.each([f"value_{name}" for name, _, _ in _FEATURES])
        begin = F.ceil(c["at"] / 8).cast("long")
        padding = cursor.field_at(raw, c["at"], (8 * begin - c["at"]).cast("int"))
        bad = (
            a["short"] | b["short"] | c["short"] | F.coalesce(padding != 0, F.lit(True)) | ((v["absolute"] == 1) & F.exists(features, lambda x: x < 0))
            | (least + b["n"] > 6) | (begin + tail["compressed_size"] > F.octet_length(data))
        )
        flag = lambda name: v[name] == 1
        return F.struct(
            flag("refresh_context").alias("refresh_context"), flag("parallel").alias("parallel"), v["context"].alias("context"),
            v["level"].alias("level"), v["sharpness"].alias("sharpness"),
            v.each([f"ref_{k}" for k in range(4)]).alias("ref_deltas"), v.each([f"mode_{k}" for k in range(2)]).alias("mode_deltas"),
            *[v[name].alias(name) for name in ("base_q", "y_dc", "uv_dc", "uv_ac")],
            ((v["base_q"] == 0) & (v["y_dc"] == 0) & (v["uv_dc"] == 0) & (v["uv_ac"] == 0)).alias("lossless"),
            flag("segmented").alias("segmented"), flag("update_map").alias("update_map"), flag("temporal").alias("temporal"),
            v.each([f"tree_{k}" for k in range(7)]).alias("tree_probabilities"), v.each([f"pred_{k}" for k in range(3)]).alias("pred_probabilities"),
            flag("absolute").alias("absolute"), F.transform(v.each([f"on_{name}" for name, _, _ in _FEATURES]), lambda x: x == 1).alias("enabled"), features.alias("features"),
            (least + b["n"]).cast("long").alias("tile_columns_log2"), (tail["rows_1"] + tail["rows_2"]).alias("tile_rows_log2"),
            tail["compressed_size"].alias("compressed_size"), begin.alias("compressed_at"), (begin + tail["compressed_size"]).alias("tiles_at"),
            F.when(bad, "invalid").alias("error"),
        )

    of_key = lambda h: F.when(h["key"] & h["error"].isNull(), cursor.bind(cursor.first_bytes(data, _HEADER_BYTES), lambda raw: fields(raw, h)))
    return cursor.bind(header, of_key)


def shown(frames: DataFrame, header: str, compressed_size: Column | None = None) -> DataFrame:
    """Frames that give an output: shown ones, and those that show an earlier one.

    A shown frame whose ``compressed_size`` is 0 has nothing in it and gives none.
    """
    empty = F.lit(False) if compressed_size is None else ~F.col(f"{header}.show_existing") & F.coalesce(compressed_size == 0, F.lit(False))
    return frames.filter((F.col(f"{header}.shown") | F.col(f"{header}.show_existing")) & F.col(f"{header}.error").isNull() & ~empty)


def tile_rows(frames: DataFrame, data: str, begin: str, width: str, height: str, columns_log2: str, rows_log2: str) -> DataFrame:
    """One row for each tile: tile, row, column, where its bytes start and end, its bounds in units of 8 samples, error.

    All tiles but the last have their size (four bytes, most significant first)
    before them, so each place follows from the sizes before it.
    """
    count = F.pow(F.lit(2.0), F.col(columns_log2) + F.col(rows_log2)).cast("int")
    start = F.struct(F.col(begin).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
    size = F.octet_length(data).cast("long")

    def step(state: Column, k: Column) -> Column:
        last = k == count - 1
        length = bits.big_endian(F.col(data), state["at"], 4)
        a = F.when(last, state["at"]).otherwise(state["at"] + 4)
        b = F.when(last, size).otherwise(a + length)
        return F.struct(b.alias("at"), F.array_append(state["out"], F.struct(a.alias("a"), b.alias("b"))).alias("out"))

    places = F.aggregate(F.sequence(F.lit(0), count - 1), start, step, lambda s: s["out"])
    rows = frames.select("*", F.posexplode(places).alias("tile", "__t"))
    wide, high = geometry.mi_units(F.col(width)), geometry.mi_units(F.col(height))
    across = F.pow(F.lit(2.0), F.col(columns_log2)).cast("int")
    row, column = F.floor(F.col("tile") / across), F.col("tile") % across
    bad = F.col("__t.b").isNull() | (F.col("__t.b") > size) | (F.col("__t.a") > size)
    return rows.select(
        *frames.columns,
        "tile",
        row.cast("int").alias("tile_row"),
        column.cast("int").alias("tile_column"),
        F.col("__t.a").alias("start"),
        F.col("__t.b").alias("end"),
        geometry.tile_offset(row, high, F.col(rows_log2)).alias("row_start"),
        geometry.tile_offset(row + 1, high, F.col(rows_log2)).alias("row_end"),
        geometry.tile_offset(column, wide, F.col(columns_log2)).alias("column_start"),
        geometry.tile_offset(column + 1, wide, F.col(columns_log2)).alias("column_end"),
        F.when(bad, "invalid").alias("error"),
    )


def slot_sizes(frames: DataFrame, stream: str, order: list[str], flags: Column, width: str, height: str, slots: int = 8) -> DataFrame:
    """``frames`` with slots: the size that each reference slot holds after the frame, null where none does yet."""
    size = F.struct(F.col(width).alias("width"), F.col(height).alias("height"))
    held = [F.when(F.shiftright(flags, i).bitwiseAND(F.lit(1)) == 1, size) for i in range(slots)]
    return scan.scan(frames, [stream], order, scan.latest_each(held, order), "slots")


def previous_vectors(frames: DataFrame, stream: str, order: list[str], width: str, height: str, visible: Column, resilient: Column, intra: Column) -> DataFrame:
    """``frames`` with use_vectors and use_segments: whether the frame before it may lend its vectors and its segment map."""
    row = F.struct(F.col(width).alias("width"), F.col(height).alias("height"), visible.alias("visible"))
    found = scan.scan(frames, [stream], order, scan.latest(row, order), "__last", inclusive=False)
    same = F.coalesce((F.col("__last.width") == F.col(width)) & (F.col("__last.height") == F.col(height)), F.lit(False)) & ~intra
    return found.withColumns({"use_vectors": same & ~resilient & F.coalesce("__last.visible", F.lit(False)), "use_segments": same}).drop("__last")


def within_limits(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """``ok``, or ``resource_limit`` where a frame is larger than its decoder was made for."""
    return F.when((width > most_width) | (height > most_height), "resource_limit").otherwise("ok")


def first_error(rows: DataFrame, key: str, phase: Column, index: Column, error: Column) -> DataFrame:
    """The error of each key with the least (phase, index): earlier phases come first, whichever worker failed first; no row without error."""
    return rows.filter(error.isNotNull()).groupBy(key).agg(F.min_by(error, F.struct(phase, index, error)).alias("error"))


def name_size(name: Column) -> Column:
    """Struct (width, height) in a golden frame's name (``…WxH-n.i420``, else ``…W-H-n.i420``), or null."""
    pattern = lambda mark: rf"(?i)(?:^|[-_])(\d+){mark}(\d+)-\d+\.i420$"

    def of(mark: str) -> Column:
        part = lambda g: F.regexp_extract(name, pattern(mark), g).try_cast("long")
        return F.when(name.rlike(pattern(mark)), F.struct(part(1).alias("width"), part(2).alias("height")))

    found = F.coalesce(of("x"), of("-"))
    return F.when((found["width"] > 0) & (found["height"] > 0), found)


def decoder_size(containers: DataFrame, golden: DataFrame, stream: str, name: Column) -> DataFrame:
    """(stream, width, height, error): the greatest width and height of a container and of its golden names.

    ``containers`` has (stream, width, height).  Where there is no size anywhere,
    error tells so.
    """
    size = name_size(name)
    named = golden.groupBy(stream).agg(F.max(size["width"]).alias("__w"), F.max(size["height"]).alias("__h"))
    text = lambda a, b: F.concat(a, F.lit("x"), b)
    rows = containers.join(named, stream, "left")
    width, height = (F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))) for a, b in (("width", "__w"), ("height", "__h")))
    missing = (width <= 0) | (height <= 0)
    why = F.concat(F.lit("decoder dimensions unavailable: container="), text(F.col("width"), F.col("height")), F.lit(", golden="), F.coalesce(text(F.col("__w"), F.col("__h")), F.lit("none")))
    return rows.select(stream, F.when(~missing, width).alias("width"), F.when(~missing, height).alias("height"), F.when(missing, why).alias("error"))


def compared(outputs: DataFrame, golden: DataFrame, stream: str, name: Column, unsized: Column) -> DataFrame:
    """Outputs that are compared: of a stream whose container has no size (``unsized``: an IVF file of 0 by 0), those whose size occurs among its golden names.

    All of such a stream's are if any of its names has no size; all of other streams' are.
    """
    named = golden.select(stream, name_size(name).alias("__s"))
    nameless = named.filter("__s IS NULL").select(stream).distinct().withColumn("__all", F.lit(True))
    sizes = named.filter("__s IS NOT NULL").select(stream, F.col("__s.width").alias("width"), F.col("__s.height").alias("height")).distinct().withColumn("__in", F.lit(True))
    rows = outputs.withColumn("__free", unsized).join(nameless, stream, "left").join(sizes, [stream, "width", "height"], "left")
    return rows.filter(~F.col("__free") | F.coalesce("__all", "__in", F.lit(False))).select(outputs.columns)


def cpu_groups(cpus: DataFrame, key: list[str], index: str) -> DataFrame:
    """Processors of equal kind: the key, its members in order; ordered by the first member."""
    found = cpus.groupBy(*key).agg(F.array_sort(F.collect_set(index)).alias("cpus"))
    return found.withColumn("first", F.col("cpus")[0]).orderBy("first")


def verdict(runs: DataFrame, ok: Column) -> DataFrame:
    """Runs, failures and the exit code of a corpus."""
    failed = F.count_if(~F.coalesce(ok, F.lit(False)))
    return runs.agg(F.count("*").alias("runs"), failed.alias("failures"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))


def report(comparisons: DataFrame, stream: str, most: int = 10, allow_mismatch: bool = False, about: DataFrame | None = None) -> DataFrame:
    """One JSON text for each stream: counters, and the first ``most`` decoded frames that differ, extra ones too.

    A stream is ok if no frame differs, is missing or is extra; with
    ``allow_mismatch`` frames may differ.  ``about`` has one row for each stream
    with what else is told (container, sizes, numbers of packets); a stream of
    it without any frame gets a report too.  Only ``most`` frames of a stream
    are ever gathered, ranked before.
    """
    differs = ~F.col("actual").eqNullSafe(F.col("expected")) & F.col("actual").isNotNull()
    listed = comparisons.filter(differs).withColumn("__n", F.row_number().over(W.partitionBy(stream).orderBy("frame"))).filter(F.col("__n") <= most)
    listed = listed.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("frame", "expected", "actual"))).alias("mismatches"))
    both = F.col("actual").isNotNull() & F.col("expected").isNotNull()
    counts = comparisons.groupBy(stream).agg(
        F.count("expected").alias("expectedCount"),
        F.count("actual").alias("comparedFrames"),
        F.count_if(both & (F.col("actual") == F.col("expected"))).alias("matchedCount"),
        F.count_if(both & (F.col("actual") != F.col("expected"))).alias("mismatchedCount"),
    )
    told = [c for c in about.columns if c != stream] if about is not None else []
    rows = (about.join(counts, stream, "left") if about is not None else counts).join(listed, stream, "left")
    rows = rows.fillna(0, ["expectedCount", "comparedFrames", "matchedCount", "mismatchedCount"])
    difference = F.col("expectedCount") - F.col("comparedFrames")
    missing, extra = F.greatest(difference, F.lit(0)), F.greatest(-difference, F.lit(0))
    ok = (missing == 0) & (extra == 0) & (F.lit(allow_mismatch) | (F.col("mismatchedCount") == 0))
    fields = [ok.alias("ok"), F.lit(allow_mismatch).alias("allowMismatch"), *told, "expectedCount", "comparedFrames", "matchedCount", "mismatchedCount", missing.alias("missingCount"), extra.alias("extraCount")]
    return rows.select(stream, F.to_json(F.struct(*fields, F.coalesce("mismatches", F.array()).alias("mismatches"))).alias("report"))
