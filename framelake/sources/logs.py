"""Tables from the text and binary logs around a decoder: JSON lines, symbol maps, profiles, run output.

Text formats are column expressions over lines or whole texts.  The two binary
formats are walked record by record, one file at a time, in ``mapInArrow``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.cursor import bind
from ..operators.ordering import carried

#: Rows of a batch that leaves a walk over binary files.
ROWS = 2000
#: How a compiled function is named.
FUNCTION_NAME = r"JS:(.*)-(\d+)-turbofan"


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, raw) of the lines of ``text`` that hold something, numbered from 0."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).filter(F.trim("raw", F.lit(" \t\r\x0b\x0c")) != "")


def parsed_json(raw: Column) -> Column:
    """VARIANT of a text, or null if it is malformed; NaN and Infinity are not JSON."""
    return F.try_parse_json(raw)


def count_json(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """Parsed and malformed lines of each key; a malformed line never stops the others."""
    good = parsed_json(F.col(raw)).isNotNull()
    return rows.groupBy(key).agg(F.count_if(good).alias("events"), F.count_if(~good).alias("malformed"))


#: Event kinds, and item kinds that are shown in a way of their own.
EVENTS = ["thread.started", "turn.started", "turn.completed", "turn.failed", "error"]
ITEM_EVENTS = ["item.started", "item.updated", "item.completed"]
ITEMS = ["agent_message", "command_execution", "file_change", "todo_list", "reasoning", "error"]


def route(event: Column) -> Column:
    """Where an event (VARIANT) goes: its type, ``item:`` and the item's type, ``other``, or ``malformed``."""
    kind = F.try_variant_get(event, "$.type", "string")
    item = F.try_variant_get(event, "$.item.type", "string")
    is_text = F.schema_of_variant(F.try_variant_get(event, "$.type", "variant")) == "STRING"
    item_is_text = F.schema_of_variant(F.try_variant_get(event, "$.item.type", "variant")) == "STRING"
    routed = F.when(kind.isin(EVENTS), kind).when(~kind.isin(ITEM_EVENTS), "other").when(~F.coalesce(item_is_text, F.lit(False)), "item:malformed").when(item.isin(ITEMS), F.concat(F.lit("item:"), item)).otherwise("item:other")
    return F.when(F.coalesce(is_text, F.lit(False)), routed).otherwise("malformed")


def token_share(event: Column) -> Column:
    """Tokens of the latest request by the size of the context window, both positive, of a token-count event; else null."""
    kind = F.try_variant_get(event, "$.payload.type", "string")
    tokens = F.try_variant_get(event, "$.payload.info.last_token_usage.total_tokens", "double")
    window = F.try_variant_get(event, "$.payload.info.model_context_window", "double")
    return F.when((kind == "token_count") & (tokens > 0) & (window > 0), tokens / F.nullif(window, F.lit(0.0)))


def member_state(value: Column, name: str) -> Column:
    """``none`` where an object lacks a member, ``null`` where it is null, else ``here``."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind.isNull(), "none").when(kind == "VOID", "null").otherwise("here")


def first_member(value: Column, *names: str) -> Column:
    """Text of the first member that is neither missing nor null."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{name}", "string") for name in names])


#: Members that label an error, those that hold what lies inside it, how deep errors are followed, and one error's short form.
LABELS, INSIDE, DEPTH = ["type", "code", "status"], ["error", "message", "param"], 5
LONG_NAME = "property_name_above_max_length"
LONG_NAME_TEXT = f"{LONG_NAME}: tool-call argument property name too long"


def script_text(value: Column) -> Column:
    """A VARIANT as scripts write it: texts as they are, whole numbers without a fraction, lists with commas, objects by a fixed word."""
    kind = F.schema_of_variant(value)
    scalar = lambda v: (
        F.when(F.schema_of_variant(v).isin("VOID"), "").when(F.schema_of_variant(v).startswith("OBJECT"), "[object Object]").when(F.schema_of_variant(v) == "DOUBLE", texts.number_text(F.try_variant_get(v, "$", "double"))).otherwise(F.try_variant_get(v, "$", "string"))
    )
    joined = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), scalar), ",")
    return F.coalesce(F.when(kind.startswith("ARRAY"), joined).otherwise(scalar(value)), F.lit(""))


def short_error(text: Column) -> Column:
    """An error's text on one line; a long message about a name's length becomes a short one with both lengths."""

    def short(one: Column) -> Column:
        lengths = [F.regexp_extract(one, rf"(?i){before} ([0-9]+)", 1) for before in ("got a string with length", "maximum length")]
        suffix = F.when((lengths[0] != "") & (lengths[1] != ""), F.concat(F.lit(" ("), lengths[0], F.lit("/"), lengths[1], F.lit(")"))).otherwise("")
        return F.when(one.contains(LONG_NAME) | one.contains("Invalid property name"), F.concat(F.lit(LONG_NAME_TEXT), suffix)).otherwise(one)

    return bind(texts.inline(text), short)


def error_text(value: Column) -> Column:
    """One line for an error (VARIANT): labels of each level before the text of the innermost one, ``DEPTH`` levels at most.

    A text that holds JSON is a level of its own.  Levels are followed by a fold
    inwards, which gathers labels, and one outwards, which puts them on.
    """
    begin = F.struct(value.alias("value"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("text"))

    def inwards(s: Column, _: Column) -> Column:
        v, kind = s["value"], F.schema_of_variant(s["value"])
        plain = F.try_variant_get(v, "$", "string")
        parsed = F.when((kind == "STRING") & plain.rlike(r"^\s*[{\[]"), F.try_parse_json(F.regexp_replace(plain, r"^\s+|\s+$", "")))
        names = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"), script_text(F.try_variant_get(v, f"$.{name}", "variant"))) for name in LABELS]
        held = [F.try_variant_get(v, f"$.{name}", "variant") for name in INSIDE]
        nested = F.coalesce(*[F.when(F.schema_of_variant(x) != "VOID", x) for x in held])
        is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
        inner = F.when(is_object, nested).otherwise(parsed)
        label = F.when(is_object, F.concat_ws("/", *names)).otherwise("")
        text = F.when(is_object, F.to_json(v)).otherwise(script_text(v))
        further = F.struct(inner.alias("value"), F.array_append(s["labels"], F.when(label != "", F.concat(label, F.lit(": "))).otherwise("")).alias("labels"), F.when(inner.isNull(), text).alias("text"))
        return F.when(s["text"].isNotNull(), s).otherwise(further)

    def outwards(s: Column) -> Column:
        # what lies deeper than all levels is told as it is
        deepest = F.coalesce(s["text"], texts.inline(script_text(s["value"])))
        return F.aggregate(F.reverse(s["labels"]), deepest, lambda text, label: short_error(F.concat(label, text)))

    return bind(F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), begin, inwards), outwards)


def temperatures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, temperature): in the section of current sensors the last BIG one, else the first of type 0; null without either."""
    each = lines(rows, key, text).withColumn("raw", F.trim("raw", F.lit(" \t\r")))
    head = F.when(F.col("raw").endswith(":"), F.col("raw"))
    inside = carried(each, key, ["line"], head, "section").filter("section = 'Current temperatures from HAL:'").filter(~F.col("raw").endswith(":"))
    value = F.regexp_extract("raw", r"mValue=([0-9]+(?:\.[0-9]+)?)", 1)
    found = inside.select(key, "line", "raw", F.when(value != "", value.cast("double")).alias("value")).filter("value IS NOT NULL")
    big, plain = F.col("raw").contains("mName=BIG"), F.col("raw").contains("mType=0,")
    best = found.groupBy(key).agg(F.max_by(F.when(big, F.col("value")), F.when(big, F.col("line"))).alias("big"), F.min_by(F.when(plain & ~big, F.col("value")), F.when(plain & ~big, F.col("line"))).alias("first"))
    return rows.select(key).distinct().join(best, key, "left").select(key, F.coalesce("big", "first").alias("temperature"))


def last_json(output: Column) -> Column:
    """VARIANT of the last line of a run's output, or null."""
    trimmed = F.regexp_replace(output, r"^\s+|\s+$", "")
    return F.try_parse_json(F.element_at(F.split(trimmed, r"\r\n|\r|\n"), -1))


#: Members of a report that say why a run failed, in the order in which they are told, and JSON texts that say nothing.
WHY = ["error", "matchedCount", "mismatchedCount", "missingCount", "extraCount", "mismatches"]
NOTHING = ["null", "false", "0", "0.0", '""', "[]", "{}"]


def run_verdict(output: Column, errors: Column) -> Column:
    """Struct (ok, detail) of a run: the report's ``ok``; if that is not true, its members that say why, as JSON, and the last five lines of ``errors``."""

    def why(report: Column) -> Column:
        members = []
        for name in WHY:
            value = F.to_json(F.try_variant_get(report, f"$.{name}", "variant"))
            members.append(F.when(~value.isin(*NOTHING), F.concat(F.lit(f'"{name}": '), value)))
        return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))

    def told(report: Column) -> Column:
        ok = F.coalesce(F.try_variant_get(report, "$.ok", "boolean"), F.lit(False))
        detail = F.when(report.isNull(), "unparseable driver output").otherwise(why(report))
        return F.struct(ok.alias("ok"), F.when(ok, "").otherwise(F.concat(detail, tail)).alias("detail"))

    last = lambda rows: F.concat(F.lit("\n  "), F.array_join(F.slice(rows, F.greatest(F.size(rows) - 4, F.lit(1)), 5), "\n  "))
    trimmed = F.regexp_replace(F.coalesce(errors, F.lit("")), r"^\s+|\s+$", "")
    tail = bind(trimmed, lambda t: F.when(t != "", bind(F.split(t, r"\r\n|\r|\n"), last)).otherwise(""))
    return bind(last_json(output), told)


def map_ranges(rows: DataFrame, raw: str, *keep: str) -> DataFrame:
    """(start, end, symbol) of symbol-map lines ``hexstart hexsize name``; other lines are left out."""
    parts = F.split(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"\s+", 3)
    hexadecimal = r"^(0[xX])?[0-9a-fA-F]{1,16}$"
    good = rows.filter((F.size(parts) == 3) & parts[0].rlike(hexadecimal) & parts[1].rlike(hexadecimal))
    number = lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("decimal(20,0)")
    return good.select(*keep, number(parts[0]).alias("start"), (number(parts[0]) + number(parts[1])).alias("end"), parts[2].alias("symbol"))


def run_times(text: Column) -> Column:
    """Struct (rtime, utime, stime, frames) of the last figures in a transcoder's messages, or null if any is missing."""
    pattern = r"bench: utime=([0-9.]+)s stime=([0-9.]+)s rtime=([0-9.]+)s"
    last = lambda p, g: F.element_at(F.regexp_extract_all(text, F.lit(p), F.lit(g)), -1)
    frames = F.try_element_at(F.regexp_extract_all(text, F.lit(r"frame=\s*([0-9]+)"), F.lit(1)), F.lit(-1)).cast("long")
    figures = F.struct(last(pattern, 3).cast("double").alias("rtime"), last(pattern, 1).cast("double").alias("utime"), last(pattern, 2).cast("double").alias("stime"), frames.alias("frames"))
    return F.when(F.regexp_like(text, F.lit(pattern)) & (frames > 0), figures)


#: Bits of a profile's sample type that stand before its period, in their order there, and its own bit.
BEFORE_PERIOD = {"identifier": 1 << 16, "ip": 1, "thread": 2, "time": 4, "address": 8, "id": 64, "stream": 512, "cpu": 128}
HAS_PERIOD = 1 << 8
#: Record kinds, and where a mapping's name stands in its record.
MAPPING, SAMPLE, MAPPING_2, CODE_LOAD = 1, 9, 10, 0
NAME_AT = {MAPPING: 32, MAPPING_2: 64}
#: The heads of records, kind and length.
PROFILE_HEAD, DUMP_HEAD = struct.Struct("<I2xH"), struct.Struct("<II8x")


def _records(data: bytes, at: int, head: struct.Struct) -> Iterator[tuple[int, int, bytes]]:
    """(number, kind, what stands behind the head) of records from ``at`` on; one that does not fit ends them."""
    n = 0
    while at + head.size <= len(data):
        kind, length = head.unpack_from(data, at)
        if length < head.size or at + length > len(data):
            return
        yield n, kind, data[at + head.size : at + length]
        at, n = at + length, n + 1


def _profile(data: bytes) -> Iterator[tuple]:
    """(kind, record, ip, period, time, start, end, file) of a profile's samples and mappings; a bad record ends it."""
    if data[:8] != b"PERFILE2" or len(data) < 56:
        raise ValueError("not a profile")
    attributes = struct.unpack_from("<Q", data, 24)[0]
    at, size = struct.unpack_from("<QQ", data, 40)
    kind = struct.unpack_from("<Q", data, attributes + 24)[0]
    if not kind & BEFORE_PERIOD["ip"]:
        raise ValueError("samples carry no address")
    place, there = 0, {}
    for name, bit in BEFORE_PERIOD.items():
        if kind & bit:
            there[name], place = place, place + 8
    if kind & HAS_PERIOD:
        there["period"] = place
    for n, record, body in _records(data[: at + size], at, PROFILE_HEAD):
        if record == SAMPLE:
            fields = {name: int.from_bytes(body[x : x + 8], "little") for name, x in there.items() if x + 8 <= len(body)}
            yield "sample", n, fields["ip"], fields.get("period", 1), fields.get("time", 0), None, None, None
        elif record in NAME_AT:
            name = body[NAME_AT[record] :].split(b"\0")
            if len(name) > 1 and name[0]:
                start, span = struct.unpack_from("<8xQQ", body)
                yield "mmap", n, None, None, None, start, start + span, name[0].decode("utf-8", "replace")


def _functions(data: bytes) -> Iterator[tuple]:
    """(record, index, mangled name, address, code) of the compiled functions in a code dump."""
    if len(data) < 16 or struct.unpack_from("<I", data)[0] != 0x4A695444:
        raise ValueError("not a code dump")
    for n, record, body in _records(data, struct.unpack_from("<I", data, 8)[0], DUMP_HEAD):
        if record == CODE_LOAD:
            address, length = struct.unpack_from("<16xQQ", body)
            text, mark, code = body[40:].partition(b"\0")
            name = re.fullmatch(FUNCTION_NAME, text.decode("utf-8", "replace"))
            if name and mark:
                yield n, int(name[2]), name[1], address, code[:length]


def _walk(files: DataFrame, key: str, content: str, walk, names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    """(key, the fields that ``walk`` yields, error) of every file; a file of another format gives one row with its error."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                for row in walk(data.as_py() or b""):
                    yield k, *row, None
            except (ValueError, KeyError, struct.error) as why:
                yield k, *[None] * len(names), str(why)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, rows = [batch.schema.field(0).type, *types, pa.string()], found(batch)
            while some := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], [key, *names, "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).cast("binary")).mapInArrow(scan, f"`{key}` {kind}, {ddl}, error string")


_U64 = pa.decimal128(20, 0)


def profile_records(files: DataFrame, key: str, content: str) -> DataFrame:
    """Samples and mappings of binary profiles; addresses and times are DECIMAL(20,0), since they may pass 2**63."""
    names = ["kind", "record", "ip", "period", "time", "start", "end", "file"]
    types = [pa.string(), pa.int64(), _U64, _U64, _U64, _U64, _U64, pa.string()]
    d = "decimal(20,0)"
    return _walk(files, key, content, _profile, names, types, f"kind string, record long, ip {d}, period {d}, time {d}, start {d}, end {d}, file string")


def compiled_functions(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, index, mangled, address, code): each function's last record, since functions are compiled again."""
    names, types = ["record", "index", "mangled", "address", "code"], [pa.int64(), pa.int64(), pa.string(), _U64, pa.binary()]
    rows = _walk(files, key, content, _functions, names, types, "record long, index long, mangled string, address decimal(20,0), code binary")
    last = rows.filter("error IS NULL").groupBy(key, "index").agg(F.max_by(F.struct("mangled", "address", "code"), "record").alias("last"))
    return last.select(key, "index", "last.mangled", "last.address", "last.code")
