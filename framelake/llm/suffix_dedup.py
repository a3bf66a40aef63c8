"""Removal of repeated byte strings, exact, by suffix arrays over what can repeat.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same one.

Each string of ``length`` bytes picks one of its ``gram``-byte pieces, the one
with the least hash, as its anchor; equal strings pick equal anchors at equal
places, so strings are compared only where anchors are.  The strings that
share one anchor occurrence form a segment.  Anchors that occur once are left
out.  Of equal segments all but the first repeat as a whole.  Different
segments around equal anchors are gathered in blocks of bounded size, and a
suffix array of each block (:mod:`suffix_groups`) brings equal strings next to
each other; the first of each run of equal strings stays.  An anchor with more
than ``HOT`` different segments is dealt over several blocks, and the first of
every string in each block then meet by hash, so no block grows with the data.

Documents are ordered by doc_id (null first), then by their place in the input,
numbered by place in its files.  Null texts are empty; texts shorter than
``length`` lose nothing; repeated rows lose all but the first; an empty table
gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from . import bitfilter
from .arrowtext import BYTE_VALUE, prefix_hashes, prime_hashes, span_hashes, text_runs
from .suffix_groups import suffix_array
from .tables import read

LENGTH = 100
GRAM = 32
FILTER_BITS = 1 << 25
HOT = 2000
BLOCK = 1500
#: Left parts of strings fall into so many classes by length; more of them find the ranges that repeat more closely.
CLASSES = 17
_PLACES = 21
#: Bytes that are hashed at a time; small enough for a core's cache.
_SLICE = 1 << 15


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Segments of some texts: (document, start in it, number of strings, anchor place from start, anchor hash, segment hash, if asked for)."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = prefix_hashes(BYTE_VALUE[data])
    at = np.arange(n - gram + 1)
    hashes = span_hashes(prefix, at, at + gram)
    low = np.uint64((1 << _PLACES) - 1)
    anchor = (_sliding_least((hashes & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    string = np.arange(len(anchor))
    document = np.searchsorted(offsets, string, "right") - 1
    whole = string + length <= offsets[document + 1]
    string, anchor, document = string[whole], anchor[whole], document[whole]
    new = np.ones(len(string), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(string)))
    start, anchor, document = string[first], anchor[first], document[first]
    return document, start - offsets[document], count, anchor - start, hashes[anchor], prime_hashes(data, start, start + count + length - 1) if hashed else None


def _slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, where its slice begins, bytes, offsets): runs of texts, long ones in slices that share ``length`` - 1 bytes."""
    for a, b, data, offsets in text_runs(column, _SLICE):
        if len(data) <= 2 * _SLICE:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data, offsets
        else:
            for x in range(0, len(data) - length + 1, _SLICE):
                part = data[x : x + _SLICE + length - 1]
                yield np.array([a]), np.array([x]), part, np.array([0, len(part)])


def _bits(built: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array; at most ``bits / 64`` rows come to the driver."""
    rows = built.toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["__word"].to_numpy(np.int64)] = rows["__bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _hit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.int64(len(bits) * 64)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs).select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The hash of every anchor occurrence."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column(0), length):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, offsets, length, gram, False)[4].view(np.int64))], ["anchor"])

    return _numbered(docs).select("text").mapInArrow(scan, "anchor long")


_SEGMENT = pa.schema([("anchor", pa.int64()), ("lead", pa.int16()), ("strings", pa.int16()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64())])


def repeated_segments(docs: DataFrame, bits: np.ndarray, length: int, gram: int) -> DataFrame:
    """Segments whose anchor is in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, base, data, offsets in _slices(batch.column(2), length):
                document, start, count, lead, anchor, own = segments(data, offsets, length, gram)
                hit = _hit(shared.value, anchor.view(np.int64))
                document = document[hit]
                of = pa.array(rows[document])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[hit].view(np.int64)), pa.array(lead[hit].astype(np.int16)), pa.array(count[hit].astype(np.int16)), pa.array(own[hit].view(np.int64)), batch.column(1).take(of), batch.column(0).take(of), pa.array(start[hit] + base[document])],
                    schema=_SEGMENT,
                )

    return _numbered(docs).mapInArrow(scan, "anchor long, lead short, strings short, segment long, doc_id long, row long, start long")


def _place_key(row: str, start: str) -> Column:
    return F.shiftright(row, 33) * 1000003 + F.col(row).bitwiseAND(F.lit((1 << 33) - 1)) * 7919 + F.col(start)


def segment_bytes(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, start, bytes) of the segments in ``wanted`` (row, start), and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(bitfilter.build(wanted, _place_key("row", "start"), FILTER_BITS), FILTER_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for rows, base, data, offsets in _slices(batch.column(1), length):
                document, start, count, _, _, _ = segments(data, offsets, length, gram, False)
                row, place = numbers[rows[document]], start + base[document]
                hit = _hit(shared.value, (row >> 33) * 1000003 + (row & ((1 << 33) - 1)) * 7919 + place)
                begin = (start + offsets[document])[hit]
                raw = data.tobytes()
                found = [raw[x : x + k + length - 1] for x, k in zip(begin.tolist(), count[hit].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(place[hit]), pa.array(found, pa.binary())], ["row", "start", "bytes"])

    return _numbered(docs).select("row", "text").mapInArrow(scan, "row long, start long, bytes binary")


def _ranges(parts: pd.DataFrame, length: int, gram: int) -> list[tuple[int, int]]:
    """For each segment the strings (first, end) that another one around the same anchor may hold.

    A string holds the anchor and something to its left and right; what all
    strings with nearly the same left part hold is compared first.
    """
    step, room = max((length - gram) // CLASSES, 1), length - gram
    last = min(CLASSES, room + 1) - 1
    seen: Counter = Counter()
    keys = []
    for anchor, lead, raw in zip(parts["anchor"], parts["lead"], parts["bytes"]):
        own = []
        for k in range(last + 1):
            least, most = k * step, room if k == last else k * step + step - 1
            x, y = lead - least, lead + length - most
            if x >= 0 and y <= len(raw):
                key = (anchor, k, raw[x:y])
                seen[key] += 1
                own.append((key, least, most))
        keys.append(own)
    out = []
    for own, lead, raw in zip(keys, parts["lead"], parts["bytes"]):
        shared = [(a, b) for key, a, b in own if seen[key] > 1]
        if shared:
            out.append((max(0, lead - max(b for _, b in shared)), min(len(raw) - length, lead - min(a for a, _ in shared)) + 1))
        else:
            out.append((0, 0))
    return out


def equal_strings(parts: pd.DataFrame, length: int, gram: int, firsts: bool) -> tuple[list[tuple], list[tuple]]:
    """Repeats among the strings of some segments, by a suffix array.

    (row, start, end) of strings that also start earlier in another segment,
    and with ``firsts`` (hash, doc_id, row, start) of the first of every string.
    """
    owner, begin, where, text, at = [], [], [], [], 0
    docs, rows, starts = parts["doc_id"].to_numpy(), parts["row"].to_numpy(), parts["start"].to_numpy()
    repeats = []
    ranges = [(0, len(raw) - length + 1) for raw in parts["bytes"]] if firsts else _ranges(parts, length, gram)
    earliest: dict[bytes, tuple[int, int]] = {}
    for k, ((x, y), raw) in enumerate(zip(ranges, parts["bytes"])):
        if y <= x:
            continue
        piece = raw[x : y + length - 1]
        have = earliest.get(piece)
        if have is None:
            earliest[piece] = k, x
            continue
        # of equal pieces the earliest enters the array, and all strings of the others repeat its own
        j, z = have
        if (docs[k], rows[k], starts[k] + x) < (docs[j], rows[j], starts[j] + z):
            earliest[piece] = k, x
            k, x = j, z
        repeats.append((int(rows[k]), int(starts[k] + x), int(starts[k] + x) + len(piece)))
    for piece, (k, x) in earliest.items():
        owner.append(k)
        begin.append(at)
        where.append(x)
        text.append(piece)
        at += len(piece) + 1
    if not text:
        return [], []
    joined = b"\xff".join(text)
    order = np.array(suffix_array(joined))
    piece = np.searchsorted(begin, order, "right") - 1
    begins, sizes = np.array(begin), np.array([len(x) for x in text])
    whole = order - begins[piece] + length <= sizes[piece]
    order, piece = order[whole], piece[whole]
    # equal strings are neighbours; their hashes only spare the comparison of unequal ones
    hashes = span_hashes(prefix_hashes(BYTE_VALUE[np.frombuffer(joined, np.uint8)]), order, order + length)
    equal = np.zeros(len(order), bool)
    for k in np.flatnonzero(hashes[1:] == hashes[:-1]).tolist():
        a, b = order[k], order[k + 1]
        equal[k + 1] = joined[a : a + length] == joined[b : b + length]
    index = np.array(owner)[piece]
    place = starts[index] + np.array(where)[piece] + order - begins[piece]
    run = np.cumsum(~equal)
    best = np.lexsort((place, rows[index], docs[index], run))
    first = np.ones(len(best), bool)
    first[1:] = run[best[1:]] != run[best[:-1]]
    later = best[~first]
    if len(later):
        key = np.lexsort((place[later], index[later]))
        own, spot = index[later][key], place[later][key]
        cut = np.ones(len(own), bool)
        cut[1:] = (own[1:] != own[:-1]) | (spot[1:] != spot[:-1] + 1)
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(own)) - 1
        repeats += [(int(rows[o]), int(x), int(y) + length) for o, x, y in zip(own[heads], spot[heads], spot[tails])]
    kept = []
    if firsts:
        for k in best[first].tolist():
            a = int(order[k])
            kept.append((hashlib.md5(joined[a : a + length]).digest(), int(docs[index[k]]), int(rows[index[k]]), int(place[k])))
    return repeats, kept


def _block_repeats(parts: DataFrame, length: int, gram: int, firsts: bool) -> DataFrame:
    """``parts`` by __block: (row, start, end, hash, doc_id); hash is null for repeats."""

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        repeats, kept = equal_strings(rows, length, gram, firsts)
        out = [(r, x, y, None, None) for r, x, y in repeats] + [(r, x, x + length, h, d) for h, d, r, x in kept]
        return pd.DataFrame(out, columns=["row", "start", "end", "hash", "doc_id"]).astype({"doc_id": "Int64"})

    return parts.groupBy("__block").applyInPandas(match, "row long, start long, end long, hash binary, doc_id long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, start, end): byte spans to remove; they may overlap."""
    docs = numbered(docs)
    often = anchors(docs, length, gram).groupBy("anchor").count().filter("count > 1")
    bits = _bits(bitfilter.build(often, F.col("anchor"), FILTER_BITS), FILTER_BITS)
    least = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    found = materialise(repeated_segments(docs, bits, length, gram).withColumn("doc_id", least), "segments")
    kind = ["anchor", "lead", "strings", "segment"]
    kinds = materialise(found.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("first")), "kinds")
    many = kinds.filter("n > 1").select(*kind, F.col("first.row").alias("__row"), F.col("first.start").alias("__start"))
    same = found.join(many, kind).filter((F.col("row") != F.col("__row")) | (F.col("start") != F.col("__start")))
    whole = same.select("row", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("end"))

    several = kinds.groupBy("anchor").agg(F.count("*").alias("__kinds")).filter("__kinds > 1")
    varied = kinds.join(several, "anchor").select("anchor", F.col("lead").cast("int").alias("lead"), "segment", "__kinds", "first.doc_id", "first.row", "first.start")
    varied = materialise(varied, "varied")
    parts = materialise(varied.join(segment_bytes(docs, varied, length, gram), ["row", "start"]), "parts")
    blocks = -(-varied.count() // BLOCK) or 1
    cold = parts.filter(F.col("__kinds") <= HOT).withColumn("__block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    out = whole.unionByName(_block_repeats(cold, length, gram, False).select("row", "start", "end"))
    hot = parts.filter(F.col("__kinds") > HOT)
    if varied.filter(F.col("__kinds") > HOT).take(1):
        share = F.pmod(F.xxhash64("segment"), F.ceil(F.col("__kinds") / F.lit(BLOCK)))
        dealt = materialise(_block_repeats(hot.withColumn("__block", F.xxhash64("anchor", share)), length, gram, True), "hot")
        firsts = dealt.filter(F.col("hash").isNotNull())
        best = firsts.groupBy("hash").agg(F.count("*").alias("__n"), F.min(F.struct("doc_id", "row", "start")).alias("__first")).filter("__n > 1")
        later = firsts.join(best, "hash").filter((F.col("row") != F.col("__first.row")) | (F.col("start") != F.col("__first.start")))
        out = out.unionByName(dealt.filter(F.col("hash").isNull()).select("row", "start", "end")).unionByName(later.select("row", "start", "end"))
    return out


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row of ``docs``."""
    docs = numbered(docs)
    spans = repeats(docs, length, gram).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = materialise(spans, "spans")
    rows = bitfilter.test(_numbered(docs), F.xxhash64("row"), bitfilter.build(spans, F.xxhash64("row")), "__in")
    changed = rows.filter("__in").drop("__in").join(spans, "row", "left")
    kind = spans.schema["spans"].dataType
    rows = rows.filter(~F.col("__in")).drop("__in").withColumn("spans", F.lit(None).cast(kind)).unionByName(changed)
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in fields.names}
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for x, y in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if x > end:
                        if end >= 0:
                            removed += end - at
                        kept.append(raw[max(end, 0) : x])
                        runs, at, end = runs + 1, x, y
                    else:
                        end = max(end, y)
                if end >= 0:
                    removed += end - at
                kept.append(raw[max(end, 0) :])
                for name, value in zip(fields.names, (doc_id, len(raw), removed, runs, b"".join(kept))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, fields)

    return rows.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
