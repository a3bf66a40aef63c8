"""Queries over containers, packets, headers and frames, with DuckDB SQL for what they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.cursor import bind
from ..operators import bench, frames, ordering
from ..operators import lineage
from ..sources import files, media
from ..storage import fresh_path, materialise
from .queries import query, spread


def _little(value: Column, n: int) -> Column:
    """Hexadecimal digits of an integer in ``n`` bytes, least significant first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])


def _payload(key: str) -> Column:
    """1 to 29 bytes of a key's digest."""
    return F.substring(F.md5(F.col(key).cast("string")), F.lit(1), (F.col(key) % 29 + 1).cast("int"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS packet_index, o_orderkey * 3 AS ts, o_orderkey % 29 + 1 AS size,
  md5(substr(md5(o_orderkey::VARCHAR), 1, (o_orderkey % 29 + 1)::INTEGER)) AS digest, 640::BIGINT AS width, 1001::BIGINT AS tb_num, NULL::VARCHAR AS error FROM orders""")
def ivf_roundtrip(table) -> DataFrame:
    """Each customer's orders as an IVF file, read back."""
    packet = F.concat(_little(F.octet_length(_payload("o_orderkey")), 4), _little(F.col("o_orderkey") * 3, 8), F.hex(_payload("o_orderkey").cast("binary")))
    head = F.concat(F.hex(F.lit("DKIF").cast("binary")), F.lit("00002400"), F.hex(F.lit("VP90").cast("binary")), F.lit("8002e001"), *[_little(F.lit(x), 4) for x in (30000, 1001)], _little(F.col("n"), 4), F.lit("00000000ffffffff"))
    files = table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", packet.alias("x")))).alias("p"), F.count("*").alias("n"))
    content = F.unhex(F.concat(head, F.array_join(F.transform("p", lambda x: x["x"]), "")))
    rows = media.packets(files.select("o_custkey", content.alias("content")), "o_custkey")
    return rows.select("o_custkey", "packet_index", "ts", F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("digest"), "width", "tb_num", "error")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ivf' WHEN 1 THEN 'webm' END AS container,
  CASE p_partkey % 3 WHEN 0 THEN 'truncated IVF header' WHEN 1 THEN 'truncated element' ELSE 'neither IVF nor WebM' END AS error FROM part""")
def container_sniff(table) -> DataFrame:
    """Files that end after their first bytes: known by them, and reported as damaged."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("444B4946", "1A45DFA3", "52494646")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = table("part").select("p_partkey", F.unhex(F.concat(head, F.lit("93"))).alias("content"))
    damaged = media.packets(files, "p_partkey").select("p_partkey", "error")
    return files.select("p_partkey", media.container(F.col("content")).alias("container")).join(damaged, "p_partkey")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS packet_index, epoch_us(ts) // 1000 - 1700000000000 AS ts, event_type = 'signup' AS keyframe,
  event_id % 29 + 1 AS size, true AS same FROM events""")
def webm_roundtrip(table) -> DataFrame:
    """Each user's events as a WebM file, in clusters, read back and compared with what was sent."""
    ms = F.floor(bench.micros("ts") / 1000).cast("long") - 1_700_000_000_000
    events = table("events").select("user_id", "event_id", ms.alias("ms"), (F.col("event_type") == "signup").alias("keyframe"), _payload("event_id").cast("binary").alias("payload"))
    clusters = ordering.mux_clusters(events, "user_id", "event_id", "ms", "keyframe")
    place = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    sent = events.join(clusters, ["user_id", "event_id"]).withColumn("packet_index", place)
    got = media.packets(media.mux(sent, "user_id", 320, 240), "user_id")
    return media.round_trip(sent.withColumnRenamed("ms", "ts"), got, "user_id", 320, 240)


@query("""SELECT user_id::VARCHAR AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS packet_index, epoch_us(ts) // 1000 - 1700000000000 AS ts, event_type = 'signup' AS keyframe,
  md5(substr(md5(event_id::VARCHAR), 1, (event_id % 29 + 1)::INTEGER)) AS digest, 320::BIGINT AS width, NULL::VARCHAR AS error FROM events""")
def media_files(table) -> DataFrame:
    """Each user's events written as a WebM file of their own, and all files read back, large ones by several tasks."""
    ms = F.floor(bench.micros("ts") / 1000).cast("long") - 1_700_000_000_000
    events = table("events").select("user_id", "event_id", ms.alias("ms"), (F.col("event_type") == "signup").alias("keyframe"), _payload("event_id").cast("binary").alias("payload"))
    sent = events.join(ordering.mux_clusters(events, "user_id", "event_id", "ms", "keyframe"), ["user_id", "event_id"]).withColumn("packet_index", F.col("event_id"))
    path = fresh_path(events.sparkSession, "media")
    files.write_webm(sent, "user_id", path, 320, 240)
    got = files.read_media(events.sparkSession, path, 4 << 20)
    # a pattern would try every place of the path for each packet
    name = F.expr("left(substring_index(stream, '/', -1), length(substring_index(stream, '/', -1)) - length('.webm'))")
    return got.select(name.alias("name"), "packet_index", "ts", "keyframe", F.md5("payload").alias("digest"), "width", "error")


@query("""SELECT l_orderkey, l_linenumber - 1 AS frame_in_packet, (sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity)::BIGINT AS start, l_quantity::BIGINT AS len FROM
  (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS l_linenumber, l_quantity FROM lineitem) WHERE l_linenumber <= 8""")
def split_superframe(table) -> DataFrame:
    """Each order's lines (8 at most) as the frames of one packet with an index at its end; a packet without one is one frame."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = table("lineitem").withColumn("k", place).filter("k <= 8")
    packets = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", F.col("l_quantity").cast("long").alias("n")))).alias("x"))
    marker = F.hex(F.lit(0xC0) + F.size("x") - 1)
    body = F.array_join(F.transform("x", lambda x: F.repeat(F.lit("41"), x["n"].cast("int"))), "")
    index = F.concat(marker, F.array_join(F.transform("x", lambda x: F.lpad(F.hex(x["n"]), 2, "0")), ""), marker)
    packets = packets.select("l_orderkey", F.unhex(F.concat(body, index)).alias("payload"))
    return frames.frame_rows(packets, media.coded_frames(F.col("payload"))).select("l_orderkey", "frame_in_packet", "start", "len")


def _binary(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value.cast("long")), n, "0")


def _packed(text: Column, size: int) -> Column:
    """BINARY of ``size`` bytes from a text of bits, filled with zeros."""
    whole = lambda bits: F.transform(F.sequence(F.lit(0), F.lit(size - 8), F.lit(8)), lambda k: F.lpad(F.conv(F.substring(bits, 8 * k + 1, F.lit(64)), 2, 16), 16, "0"))
    return F.unhex(F.array_join(bind(F.rpad(text, 8 * size, "0"), whole), ""))


def _optional(there: Column, *parts: Column) -> Column:
    """A bit that tells whether the parts are there, and they if they are."""
    return F.when(there, F.concat(F.lit("1"), *parts)).otherwise("0")


def _only(there: Column, *parts: Column) -> Column:
    return F.when(there, F.concat(*parts)).otherwise("")


def _rest(key: Column, width: Column) -> Column:
    """Bits of a key frame's header after its sizes: every optional field is there for some keys and not for others."""
    b = _binary
    signed = lambda there, value, n, sign: _optional(there, b(value, n), b(sign, 1))
    deltas = [signed((key + r) % 2 == 1, (key + r) % 64, 6, F.lit(r % 2)) for r in range(4)] + [signed((key + m) % 3 == 1, key % 50, 6, key % 2) for m in range(2)]
    tree = [_optional((key + i) % 3 == 0, b(key * (i + 1) % 256, 8)) for i in range(7)]
    pred = [_optional((key + i) % 2 == 0, b(key * (i + 2) % 256, 8)) for i in range(3)]
    features = []
    for s in range(8):
        for k, n in enumerate((8, 6, 2, 0)):
            parts = [b((key + s) % (1 << n), n)] if n else []
            parts += [b(((s + key) % 5 == 0).cast("int"), 1)] if k < 2 else []
            features.append(_optional((key + s + k) % 4 == 0, *parts))
    least, most = geometry.tile_log2_bounds(width)
    tiles = F.least(key % 3, most - least)
    return F.concat(
        _only(key % 4 != 0, b(key % 2, 1), b(F.floor(key / 2) % 2, 1)), b(key % 4, 2), b(key % 64, 6), b(key % 8, 3),
        _optional(key % 3 == 0, _optional(key % 6 == 0, *deltas)),
        b(key % 13 % 4 * 60, 8), signed(key % 5 == 1, key % 16, 4, key % 2), F.lit("0"), signed(key % 7 == 2, key % 9, 4, F.lit(1)),
        _optional(key % 4 == 1, _optional(key % 8 == 1, *tree, _optional(key % 16 == 1, *pred)), _optional(key % 3 == 1, b(F.floor(key / 4) % 2, 1), *features)),
        F.repeat(F.lit("1"), tiles.cast("int")), F.when(tiles < most - least, "0").otherwise(""),
        F.element_at(F.array(F.lit("0"), F.lit("10"), F.lit("11")), (key % 3 + 1).cast("int")), b(key % 60, 16),
    )


def _headers(table) -> DataFrame:
    """Headers with sizes, flags and all later fields from a part's number: one in five shows an earlier frame, one in seven has a wrong marker."""
    key = F.col("p_partkey")
    width, height = key * 7 % 4096 + 1, key * 3 % 2160 + 1
    sizes = [_binary(F.lit(0x498342), 24), F.lit("0010"), _binary(width - 1, 16), _binary(height - 1, 16)]
    render = F.when(key % 2 == 0, F.lit("0")).otherwise(F.concat(F.lit("1"), _binary(width + 1, 16), _binary(height + 1, 16)))
    flags = F.concat(F.when(key % 3 > 0, "1").otherwise("0"), F.when(key % 4 == 0, "1").otherwise("0"))
    plain = F.concat(F.lit("00"), flags, *sizes, render, _rest(key, width))
    head = F.when(key % 7 == 0, "0100").otherwise("1000")
    text = F.concat(head, F.when(key % 5 == 0, F.concat(F.lit("1"), _binary(key % 8, 3))).otherwise(plain))
    rows = materialise(spread(table("part").select("p_partkey"), "p_partkey").select("p_partkey", _packed(text, 192).alias("data")), "frames")
    # stored headers are small, so a few tasks would read them all
    rows = spread(rows, "p_partkey").select("p_partkey", "data", frames.key_header(F.col("data")).alias("h"))
    return rows.select("p_partkey", "h", frames.key_fields(F.col("data"), F.col("h")).alias("f"))


_K = "p_partkey"
_LIST = lambda parts: "[" + ", ".join(parts) + "]::BIGINT[]"
_SIGNED = lambda there, value, sign, missing=0: f"CASE WHEN {there} THEN ({value}) * (1 - 2 * ({sign})) ELSE {missing} END"
_ON = [f"(upd AND (k + {s + j}) % 4 = 0)" for s in range(8) for j in range(4)]
_VALUES = [f"CASE WHEN {_ON[4 * s + j]} THEN ((k + {s}) % {1 << n}) * (1 - {2 if j < 2 else 0} * ((k + {s}) % 5 = 0)::INT) ELSE 0 END" for s in range(8) for j, n in enumerate((8, 6, 2, 0))]
_HEADERS = f"""h AS (SELECT p_partkey, p_partkey AS k, p_partkey % 7 = 0 AS bad, p_partkey % 5 = 0 AS existing, p_partkey * 7 % 4096 + 1 AS w, p_partkey * 3 % 2160 + 1 AS h,
  p_partkey % 2 AS more, p_partkey % 3 > 0 AS shown, p_partkey % 4 = 1 AS seg, p_partkey % 4 = 1 AND p_partkey % 3 = 1 AS upd, (p_partkey * 7 % 4096 + 64) // 64 AS sb FROM part),
v AS (SELECT *, NOT existing AND NOT bad AS plain, {_LIST(_VALUES)} AS features, upd AND k // 4 % 2 = 1 AS absolute,
  CASE WHEN sb <= 64 THEN 0 ELSE 1 END AS least, len([x FOR x IN [1, 2, 3, 4, 5, 6] IF sb >> x >= 4]) AS most FROM h)"""


@query(f"""WITH {_HEADERS} SELECT p_partkey, existing, CASE WHEN existing THEN p_partkey % 8 END AS slot, NOT existing AS key, CASE WHEN existing THEN NULL ELSE p_partkey % 4 = 0 END AS resilient,
  CASE WHEN NOT existing THEN w END AS width, CASE WHEN NOT existing THEN h END AS height, CASE WHEN NOT existing THEN w + 2 * more END AS render_width,
  CASE WHEN NOT existing THEN h + 2 * more END AS render_height, CASE WHEN bad THEN 'invalid' END AS error,
  CASE WHEN plain THEN k % 4 <> 0 AND k % 2 = 1 END AS refresh_context, CASE WHEN plain THEN k % 4 = 0 OR k // 2 % 2 = 1 END AS parallel, CASE WHEN plain THEN k % 4 END AS context,
  CASE WHEN plain THEN k % 64 END AS level, CASE WHEN plain THEN k % 8 END AS sharpness,
  CASE WHEN plain THEN {_LIST([_SIGNED(f"k % 6 = 0 AND (k + {r}) % 2 = 1", f"(k + {r}) % 64", r % 2, d) for r, d in enumerate((1, 0, -1, -1))])} END AS ref_deltas,
  CASE WHEN plain THEN {_LIST([_SIGNED(f"k % 6 = 0 AND (k + {m}) % 3 = 1", "k % 50", "k % 2") for m in range(2)])} END AS mode_deltas,
  CASE WHEN plain THEN k % 13 % 4 * 60 END AS base_q, CASE WHEN plain THEN {_SIGNED("k % 5 = 1", "k % 16", "k % 2")} END AS y_dc, CASE WHEN plain THEN 0::BIGINT END AS uv_dc,
  CASE WHEN plain THEN {_SIGNED("k % 7 = 2", "k % 9", "1")} END AS uv_ac,
  CASE WHEN plain THEN k % 13 % 4 = 0 AND (k % 5 <> 1 OR k % 16 = 0) AND (k % 7 <> 2 OR k % 9 = 0) END AS lossless,
  CASE WHEN plain THEN seg END AS segmented, CASE WHEN plain THEN seg AND k % 16 = 1 END AS temporal, CASE WHEN plain THEN absolute END AS absolute,
  CASE WHEN plain THEN {_LIST([f"CASE WHEN seg AND k % 8 = 1 AND (k + {i}) % 3 = 0 THEN k * {i + 1} % 256 ELSE 255 END" for i in range(7)])} END AS tree_probabilities,
  CASE WHEN plain THEN {_LIST([f"CASE WHEN seg AND k % 16 = 1 AND (k + {i}) % 2 = 0 THEN k * {i + 2} % 256 ELSE 255 END" for i in range(3)])} END AS pred_probabilities,
  CASE WHEN plain THEN [{", ".join(_ON)}] END AS enabled, CASE WHEN plain THEN features END AS features,
  CASE WHEN plain THEN (least + least(k % 3, most - least))::BIGINT END AS tile_columns_log2, CASE WHEN plain THEN k % 3 END AS tile_rows_log2,
  CASE WHEN plain THEN k % 60 END AS compressed_size, CASE WHEN plain AND absolute AND len([x FOR x IN features IF x < 0]) > 0 THEN 'invalid' END AS field_error FROM v""")
def keyframe_header(table) -> DataFrame:
    h = _headers(table).select("p_partkey", "h.*", "f")
    names = ["refresh_context", "parallel", "context", "level", "sharpness", "ref_deltas", "mode_deltas", "base_q", "y_dc", "uv_dc", "uv_ac", "lossless", "segmented", "temporal", "absolute"]
    names += ["tree_probabilities", "pred_probabilities", "enabled", "features", "tile_columns_log2", "tile_rows_log2", "compressed_size"]
    return h.select(
        "p_partkey", F.col("show_existing").alias("existing"), F.col("existing_slot").alias("slot"), "key", "resilient", "width", "height", "render_width", "render_height", "error",
        *[f"f.{name}" for name in names], F.col("f.error").alias("field_error"),
    )


@query(f"WITH {_HEADERS} SELECT p_partkey FROM v WHERE (existing OR (shown AND k % 60 > 0)) AND NOT bad")
def shown_frames(table) -> DataFrame:
    """Shown frames; those without compressed data give nothing."""
    # stored, or the filter would go below the dealing and read headers in a few tasks
    told = materialise(_headers(table).select("p_partkey", "h", F.col("f.compressed_size").alias("n")), "headers")
    return frames.shown(told, "h", F.col("n")).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 AS c, p_partkey % 2 AS r, p_size * 64 AS w, p_size * 32 AS h FROM part),
t AS (SELECT *, unnest(range(1 << (c + r))) AS tile FROM p),
s AS (SELECT *, tile // (1 << c) AS i, tile % (1 << c) AS j, (w + 7) // 8 AS mc, (h + 7) // 8 AS mr, 5 + tile * (tile + 3) // 2 + 4 * least(tile + 1, (1 << (c + r)) - 1) AS a,
  CASE WHEN tile = (1 << (c + r)) - 1 THEN 3 ELSE tile + 2 END AS n FROM t)
SELECT p_partkey, tile::INTEGER AS tile, i::INTEGER AS tile_row, j::INTEGER AS tile_column, a AS start, a + n AS "end",
  least((i * ((mr + 7) // 8) >> r) * 8, mr) AS row_start, least(((i + 1) * ((mr + 7) // 8) >> r) * 8, mr) AS row_end,
  least((j * ((mc + 7) // 8) >> c) * 8, mc) AS column_start, least(((j + 1) * ((mc + 7) // 8) >> c) * 8, mc) AS column_end, NULL::VARCHAR AS error FROM s""")
def tile_layout(table) -> DataFrame:
    """Tile k has k + 2 bytes, the last one 3; the header before them has 5."""
    key = F.col("p_partkey")
    rows = table("part").select("p_partkey", (key % 3).alias("c"), (key % 2).alias("r"), (F.col("p_size") * 64).cast("long").alias("w"), (F.col("p_size") * 32).cast("long").alias("h"))
    count = F.pow(F.lit(2.0), F.col("c") + F.col("r")).cast("int")
    tile = lambda k: F.when(k == count - 1, "cccccc").otherwise(F.concat(F.lpad(F.hex((k + 2).cast("long")), 8, "0"), F.repeat(F.lit("aa"), k + 2)))
    body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), tile), "")
    data = rows.withColumn("data", F.unhex(F.concat(F.lit("0102030405"), body))).withColumn("begin", F.lit(5))
    return frames.tile_rows(data, "data", "begin", "w", "h", "c", "r").drop("c", "r", "w", "h", "data", "begin")


def _names() -> Column:
    """Golden names with sizes in both spellings; those of one source lack them."""
    key = F.col("doc_id")
    size = F.concat(key % 3 * 16 + 16, F.when(key % 2 == 0, "x").otherwise("-"), key % 2 * 8 + 8)
    return F.concat(F.lit("clip-"), F.when(F.col("source") == F.lit("src0"), "a").otherwise(size), F.lit("-"), key, F.lit(".i420"))


_NAMES = """n AS (SELECT doc_id, source, CASE WHEN source = 'src0' THEN NULL ELSE doc_id % 3 * 16 + 16 END AS w, CASE WHEN source = 'src0' THEN NULL ELSE doc_id % 2 * 8 + 8 END AS h FROM documents)"""


@query(f"""WITH {_NAMES} SELECT doc_id FROM documents d WHERE source = 'src2' OR EXISTS (SELECT 1 FROM n WHERE n.source = d.source AND (n.w IS NULL OR (n.w = d.doc_id % 4 * 16 + 16 AND n.h = 8)))""")
def compared_outputs(table) -> DataFrame:
    """All containers but one are IVF files without a size; that one's outputs are compared whatever their size."""
    docs = table("documents")
    outputs = docs.select("doc_id", "source", (F.col("doc_id") % 4 * 16 + 16).alias("width"), F.lit(8).cast("long").alias("height"))
    return frames.compared(outputs, docs, "source", _names(), F.col("source") != "src2").select("doc_id")


@query(f"""WITH {_NAMES}, c AS (SELECT DISTINCT source, CASE source WHEN 'src1' THEN 100 ELSE 0 END AS cw, CASE source WHEN 'src1' THEN 9 WHEN 'src2' THEN 7 ELSE 0 END AS ch FROM documents),
m AS (SELECT source, cw, ch, max(w) AS w, max(h) AS h FROM c LEFT JOIN n USING (source) GROUP BY ALL)
SELECT source, CASE WHEN greatest(cw, w) > 0 AND greatest(ch, h) > 0 THEN greatest(cw, w) END::BIGINT AS width, CASE WHEN greatest(cw, w) > 0 AND greatest(ch, h) > 0 THEN greatest(ch, h) END::BIGINT AS height,
  CASE WHEN greatest(cw, w) > 0 AND greatest(ch, h) > 0 THEN NULL ELSE 'decoder dimensions unavailable: container=' || cw || 'x' || ch || ', golden=' || coalesce(w || 'x' || h, 'none') END AS error FROM m""")
def golden_size(table) -> DataFrame:
    """The greater of a container's size and of its golden names; an error where neither is known."""
    docs, source = table("documents"), F.col("source")
    containers = docs.select("source").distinct().withColumns({"width": F.when(source == "src1", 100).otherwise(0).cast("long"), "height": F.when(source == "src1", 9).when(source == "src2", 7).otherwise(0).cast("long")})
    return frames.decoder_size(containers, docs, "source", _names())


@query("""SELECT p_partkey, CASE WHEN p_size * 16 > 640 OR p_partkey > 1500 THEN 'resource_limit' ELSE 'ok' END AS status, (p_size + 1) // 2 * ((p_partkey % 90 + 1) // 2) AS chroma,
  p_size * (p_partkey % 90) + 2 * ((p_size + 1) // 2 * ((p_partkey % 90 + 1) // 2)) AS bytes, md5(repeat('abc', 2)) AS plane FROM part""")
def plane_geometry(table) -> DataFrame:
    """Limits, the planes' places, and a plane of two rows of three samples cut out of rows of five."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    bounds = geometry.plane_bounds(size, key % 90)
    plane = geometry.compact_plane(F.lit("abcxxabcxx").cast("binary"), 5, 3, 2)
    return table("part").select(
        "p_partkey",
        frames.within_limits(size * 16, key, 640, 1500).alias("status"),
        (bounds[1]["end"] - bounds[1]["start"]).alias("chroma"),
        bounds[2]["end"].alias("bytes"),
        F.md5(plane).alias("plane"),
    )


_SLOT_SQL = ", ".join(f"last_value(CASE WHEN (event_id >> {i}) & 1 = 1 THEN event_id % 100 * 16 END IGNORE NULLS) OVER w" for i in range(8))


@query(f"SELECT event_id, [{_SLOT_SQL}] AS widths FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def reference_sizes(table) -> DataFrame:
    rows = table("events").withColumns({"w": F.col("event_id") % 100 * 16, "h": F.lit(8)})
    held = frames.slot_sizes(rows, "user_id", ["ts", "event_id"], F.col("event_id"), "w", "h")
    return held.select("event_id", F.transform("slots", lambda s: s["width"]).alias("widths"))


@query("""WITH l AS (SELECT event_id, event_id // 3 % 3 AS w, event_type, lag(event_id // 3 % 3) OVER o AS pw, lag(event_type) OVER o AS pt FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(w = pw, false) AND event_type <> 'signup' AND event_type <> 'click' AND coalesce(pt <> 'error', false) AS use_vectors, coalesce(w = pw, false) AND event_type <> 'signup' AS use_segments FROM l""")
def previous_vectors(table) -> DataFrame:
    kind = F.col("event_type")
    rows = table("events").withColumns({"w": F.floor(F.col("event_id") / 3) % 3, "h": F.lit(8)})
    return frames.previous_vectors(rows, "user_id", ["ts", "event_id"], "w", "h", kind != "error", kind == "click", kind == "signup").select("event_id", "use_vectors", "use_segments")


@query("""SELECT user_id, arg_min(event_type, (CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id)) AS error FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def first_error(table) -> DataFrame:
    kind = F.col("event_type")
    return frames.first_error(table("events"), "user_id", F.when(kind == "error", 0).otherwise(1), F.col("event_id"), F.when(kind != "view", kind))


@query("""SELECT c_mktsegment, c_nationkey, list(DISTINCT c_custkey ORDER BY c_custkey) AS cpus, min(c_custkey) AS first FROM customer GROUP BY ALL""")
def cpu_groups(table) -> DataFrame:
    return frames.cpu_groups(table("customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")


@query("SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS failures, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 1 ELSE 0 END AS exit_code FROM orders")
def corpus_verdict(table) -> DataFrame:
    return frames.verdict(table("orders"), F.col("o_orderstatus") != "F")


@query("""WITH m AS (SELECT user_id, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / nullif(count(*) - 1, 0) / 1000 AS budget, sum(value) AS ms FROM events GROUP BY user_id)
SELECT user_id, round(ms / n, 6) AS ms_per_frame, round(budget / nullif(ms / n, 0), 4) AS realtime FROM m""")
def bench_lanes(table) -> DataFrame:
    return bench.lanes(table("events"), "user_id", bench.micros("ts"), "value")


@query("SELECT event_id, event_id % 1000 = 0 AS progress FROM events WHERE event_id > 0 AND event_id % 500 = 0")
def progress_every(table) -> DataFrame:
    return ordering.every(table("events"), "event_id", 500).select("event_id", (F.col("event_id") % 1000 == 0).alias("progress"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def packet_limit(table) -> DataFrame:
    return ordering.first_packets(table("events"), ["event_id"], 100).select("event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 20")
def session_order(table) -> DataFrame:
    """The newest sessions first, by path where times are equal; a report of 20."""
    found = ordering.newest_first(table("orders"), "o_totalprice", "o_orderkey", 20)
    return found.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT user_id AS stream, event_id AS frame, CASE WHEN user_id % 4 <> 1 OR event_id % 3 > 0 THEN md5(event_type) END AS actual,
  CASE WHEN user_id % 4 <> 2 OR event_id % 3 > 0 THEN md5(CASE WHEN user_id % 4 = 3 AND event_id % 5 = 0 THEN 'x' ELSE event_type END) END AS expected FROM events),
m AS (SELECT stream, list({'frame': frame, 'expected': expected, 'actual': actual} ORDER BY frame) AS list FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY frame) AS n FROM a
  WHERE actual IS NOT NULL AND actual IS DISTINCT FROM expected) WHERE n <= 10 GROUP BY stream),
c AS (SELECT stream, count(expected) AS wanted, count(actual) AS compared, count(*) FILTER (actual = expected) AS matched, count(*) FILTER (actual <> expected) AS mismatched FROM a GROUP BY stream)
SELECT stream, wanted = compared AND mismatched = 0 AS ok, wanted = compared AS lenient, wanted, compared, matched, mismatched, greatest(wanted - compared, 0) AS missing, greatest(compared - wanted, 0) AS extra,
  'webm' AS container, coalesce(len(list), 0) AS listed, list[1].frame AS first FROM c LEFT JOIN m USING (stream)""")
def json_report(table) -> DataFrame:
    """Reports of streams that are whole, lack frames, have more of them, or differ; the JSON texts' fields are read back."""
    kind, key, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    expected = F.when((user % 4 != 2) | (key % 3 > 0), F.md5(F.when((user % 4 == 3) & (key % 5 == 0), "x").otherwise(kind)))
    actual = F.when((user % 4 != 1) | (key % 3 > 0), F.md5(kind))
    rows = table("events").select(user.alias("stream"), key.alias("frame"), actual.alias("actual"), expected.alias("expected"))
    about = rows.select("stream").distinct().withColumn("container", F.lit("webm"))
    fields = "ok boolean, container string, expectedCount long, comparedFrames long, matchedCount long, mismatchedCount long, missingCount long, extraCount long, mismatches array<struct<frame: long>>"
    told = frames.report(rows, "stream", about=about).withColumn("r", F.from_json("report", fields))
    lenient = frames.report(rows, "stream", allow_mismatch=True).select("stream", F.from_json("report", "ok boolean")["ok"].alias("lenient"))
    return told.join(lenient, "stream").select(
        "stream", "r.ok", "lenient", F.col("r.expectedCount").alias("wanted"), F.col("r.comparedFrames").alias("compared"), F.col("r.matchedCount").alias("matched"), F.col("r.mismatchedCount").alias("mismatched"),
        F.col("r.missingCount").alias("missing"), F.col("r.extraCount").alias("extra"), "r.container", F.size("r.mismatches").cast("long").alias("listed"), F.get("r.mismatches", F.lit(0))["frame"].alias("first"),
    )


_REFRESHED = ", ".join(f"last_value(CASE WHEN (event_id >> {i}) & 1 = 1 THEN event_id END IGNORE NULLS) OVER w" for i in range(8))


@query(f"""WITH RECURSIVE h AS (SELECT user_id, event_id, [{_REFRESHED}] AS held FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT user_id, event_id, held[event_id // 8 % 8 + 1] AS source, CASE WHEN event_id % 5 = 0 THEN event_id % 100 * 16 END AS width FROM h),
r AS (SELECT user_id, event_id, width FROM f WHERE width IS NOT NULL UNION ALL SELECT f.user_id, f.event_id, r.width FROM f JOIN r ON f.user_id = r.user_id AND f.source = r.event_id WHERE f.width IS NULL)
SELECT f.event_id, r.width, CASE WHEN r.width IS NULL THEN 'invalid' END AS error FROM f LEFT JOIN r ON f.user_id = r.user_id AND f.event_id = r.event_id""")
def size_from_refs(table) -> DataFrame:
    """Every fifth frame has a size of its own; the others take that of the frame in a slot, which may have taken it from another."""
    key = F.col("event_id")
    rows = table("events").select("user_id", "ts", "event_id", F.when(key % 5 == 0, key % 100 * 16).alias("own"))
    held = ordering.slot_lineage(rows, "user_id", ["ts", "event_id"], "event_id", key, F.floor(key / 8) % 8)
    found = lineage.inherit(held, "user_id", "event_id", F.col("source"), F.col("own"), "width")
    return found.select("event_id", "width", F.when(F.col("width").isNull(), "invalid").alias("error"))
