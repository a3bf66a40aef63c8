"""Benchmark decontamination by template canonicalisation.

Words are case-folded runs of letters and digits, by the rules of Unicode, so
a copy in capitals has the same words.  Words become tokens: numbers, names (a
capital after a word of the same sentence, or before such a name) and units are
replaced by typed placeholders, and a name of several words or a number with
points or commas inside is one token, so a new value may have another number of
words.  Every run of ``window`` tokens becomes a template hash, in the benchmark
as in the documents.  Whether a word is a name hangs on the text around it, so
every run of ``window`` words is also hashed in its literal form, all words as
they are.  Document windows whose hash is in the benchmark meet it in a hash
join; before that a filter of fixed size, built from the benchmark, leaves out
nearly all others.  Benchmark items shorter than a window are one window of their
own length; documents are read once for all lengths.

Joined windows are lined up: those of one document, item and form with the same
distance between their places form an alignment.  In the literal form it is a
leak if its windows are at least ``coverage`` of the item's, or ``run`` of them.
In the typed form each benchmark value stands for the document's value that most
of the windows give it (of equals the unchanged one, then the least hash);
several benchmark values may become one.  A window counts if all its slots agree
with that, or if none is changed, and if it holds ``literals`` plain tokens at
least (all of them in a shorter item); the windows that count must be ``coverage``
of the item's windows that can, or ``run`` of them.  An item without such a
window is found by all its windows together, if these hold ``literals`` plain
tokens in all.

Defined results: null and empty texts have no windows; repeated documents and
items are each reported; null ids are kept as values; no benchmark or no
documents give no rows; other columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from . import bitfilter
from .arrowtext import mix, prefix_hashes, span_hashes, text_runs, word_hashes, word_spans
from .tables import free_names, read

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
RUN = 6
FILTER_BITS = 1 << 22

#: Words that are units where they follow a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile inches inch feet foot meters meter metres metre kilometers kilometer kilometres kilometre "
    "mg g kg t lb lbs oz pounds pound grams gram kilograms kilogram tons ton ml l liters liter litres litre gallons gallon "
    "s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "percent usd eur gbp dollars dollar cents cent euros euro kmh mph hz khz mhz ghz kb mb gb tb w kw v a c f k"
).split()

#: Words are runs of letters or of digits: 5kg is two.
_word_bytes = np.zeros(256, np.uint8)
_word_bytes[65:91] = _word_bytes[97:123] = 1
_word_bytes[48:58] = 2
_word_bytes[128:] = 1
_digits = np.zeros(256, bool)
_digits[48:58] = True
_stops = np.zeros(256, bool)
_stops[[10, 13, 33, 46, 58, 59, 63]] = True
#: Case of a code point: 1 for capitals, 2 for small letters.
_case = np.fromiter((1 if c.isupper() or c.istitle() else 2 * c.islower() for c in map(chr, range(0x1F000))), np.uint8, 0x1F000)
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_PLACEHOLDER = mix(np.arange(1, 5, dtype=np.uint64))


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return word_hashes(data, np.concatenate([[0], ends[:-1]]), ends)


_UNIT_HASHES = np.sort(_hash_words(UNITS))


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of case-folded texts.

    Word bytes fold to word bytes and others to themselves, so both versions of
    a text have the same number of words.
    """
    raw, out = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = raw[a:b]
        out.append(text.lower() if text.isascii() else text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape"))
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])


def _cases(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case of each word's first and second code point (0 where there is none)."""
    far = np.concatenate([data, np.zeros(8, np.uint8)])

    def case(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead, *rest = (far[at + k].astype(np.int64) for k in range(4))
        tail = [x & 63 for x in rest]
        size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        point = np.choose(size - 1, [lead, (lead & 31) << 6 | tail[0], (lead & 15) << 12 | tail[0] << 6 | tail[1], (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]])
        return np.where(point < len(_case), _case[np.minimum(point, len(_case) - 1)], 0), at + size

    opening, after = case(start)
    return opening, np.where(after < end, case(np.minimum(after, len(data)))[0], 0)


class Forms:
    """Some texts in literal and typed form.

    For each form: ``hashes`` (prefix hashes over words or tokens), ``first``
    (where each text's begin), ``document`` of each.  ``plain`` tells which tokens
    are literals, and ``values`` what each token stands for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, first = word_spans(data, offsets, _word_bytes)
        low, ends = folded(data, offsets)
        begin, stop, _ = word_spans(low, ends, _word_bytes)
        words = word_hashes(low, begin, stop)
        n = len(start)
        document = np.searchsorted(first[1:], np.arange(n), "right")
        literal = prefix_hashes(words)
        head, kind = np.ones(n, bool), np.full(n, _LITERAL, np.int8)
        if n:
            kind, head = self._kinds(data, start, end, document, words)
        at = np.flatnonzero(head)
        close = np.append(at[1:], n)
        self.values = span_hashes(literal, at, close).view(np.int64)
        self.plain = kind[at] == _LITERAL
        tokens = np.where(self.plain, words[at], _PLACEHOLDER[kind[at]])
        self.hashes = literal, prefix_hashes(tokens)
        self.first = first, np.searchsorted(at, first)
        self.document = document, document[at]

    @staticmethod
    def _kinds(data: np.ndarray, start: np.ndarray, end: np.ndarray, document: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each word, and whether it begins a token."""
        n = len(start)
        digits = np.concatenate([[0], np.cumsum(_digits[data])])
        stops = np.concatenate([[0], np.cumsum(_stops[data])])
        number = digits[end] - digits[start] == end - start
        same, gap = np.zeros(n, bool), np.zeros(n, np.uint8)  # gap: the byte before a word if it is the only one there
        same[1:] = document[1:] == document[:-1]
        one = np.flatnonzero(same[1:] & (start[1:] == end[:-1] + 1)) + 1
        gap[one] = data[end[one - 1]]
        follows = same.copy()
        follows[1:] &= stops[start[1:]] == stops[end[:-1]]
        opening, second = _cases(data, start, end)
        # capitals alone are a name among other words, and nothing in a text of capitals
        capitals = (opening == 1) & (second == 1)
        alone = capitals.copy()
        alone[1:] &= ~(capitals[:-1] & same[1:])
        alone[:-1] &= ~(capitals[1:] & same[1:])
        kind = np.full(n, _LITERAL, np.int8)
        name = (opening == 1) & (second == 2) | alone
        kind[name & follows] = _NAME
        opens = name & ~follows
        opens[:-1] &= (kind[1:] == _NAME) & (gap[1:] == 32)
        opens[-1:] = False
        kind[opens] = _NAME
        unit = follows.copy()
        unit[1:] &= number[:-1]
        unit &= _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, words), len(_UNIT_HASHES) - 1)] == words
        kind[unit] = _UNIT
        kind[number] = _NUMBER
        joined = np.zeros(n, bool)
        joined[1:] = ((kind[1:] == _NAME) & (kind[:-1] == _NAME) & (gap[1:] == 32)) | (number[1:] & number[:-1] & ((gap[1:] == 44) | (gap[1:] == 46)))
        return kind, ~joined


#: Windows of the typed form hash apart from those of the literal one.
_TYPED = np.uint64(0x5851F42D4C957F2D)


def windows(rows: DataFrame, carry: str, lengths: dict[bool, list[int]], literals: int = LITERALS, only: np.ndarray | None = None, items: bool = False) -> DataFrame:
    """``carry``, __row, template, typed, length, place, slots, counts, windows and eligible of the windows of both forms.

    ``lengths`` are those of each form (typed or not).  ``slots`` are the value
    hashes at placeholders.  ``only`` is a filter's bits; windows outside it are
    left out.  With ``items`` the first length of a form holds, or the text's own
    if that is less, and three fields are filled: whether a window counts, how
    many windows the text has in this form, and how many of them count, negative
    if all must be met.
    """
    spark = rows.sparkSession
    shared = None if only is None else spark.sparkContext.broadcast(only)
    long = pa.int64()
    fields = pa.schema([("__key", long), ("__row", long), ("template", long), ("typed", pa.bool_()), ("length", long), ("place", long), ("slots", pa.list_(long)), ("counts", pa.bool_()), ("windows", long), ("eligible", long)])

    def form(found: Forms, typed: bool, length: int, bits: np.ndarray | None) -> tuple | None:
        first, document = found.first[typed], found.document[typed]
        size = np.diff(first)
        at = np.arange(len(document))
        long = np.minimum(length, size[document]) if items else np.full(len(at), length)
        fits = at - first[document] + long <= size[document]
        at, long = at[fits], long[fits]
        if not len(at):
            return None
        hashes = span_hashes(found.hashes[typed], at, at + long)
        hashes = (hashes ^ _TYPED if typed else hashes).view(np.int64)
        windows, counts, eligible = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        if items:
            owner = document[at]
            windows = np.bincount(owner, minlength=len(size))[owner]
            plain = np.concatenate([[0], np.cumsum(found.plain)])
            counts = plain[at + long] - plain[at] >= np.minimum(literals, long) if typed else np.ones(len(at), bool)
            eligible = np.bincount(owner[counts], minlength=len(size))[owner]
            whole = plain[first[1:]] - plain[first[:-1]] if typed else size
            strict = (eligible == 0) & (whole[owner] >= literals)
            counts, eligible = counts | strict, np.where(strict, -windows, eligible)
        if bits is not None:
            slot = hashes % np.int64(len(bits) * 64)
            hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, long, hashes, windows, counts, eligible = (x[hit] for x in (at, long, hashes, windows, counts, eligible))
        if items:
            at, long, hashes, windows, eligible, counts = (x[counts] for x in (at, long, hashes, windows, eligible, counts))
        slots = [found.values[i : i + n][~found.plain[i : i + n]] for i, n in zip(at.tolist(), long.tolist())] if typed else [[]] * len(at)
        return document[at], hashes, long, at - first[document[at]], slots, counts, windows, eligible

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for a, _, data, offsets in text_runs(batch.column(2)):
                found = Forms(data, offsets)
                for typed in (False, True):
                    for length in lengths[typed]:
                        out = form(found, typed, length, bits)
                        if out is not None and len(out[0]):
                            of = pa.array(out[0] + a)
                            rest = [pa.array(x, kind.type) for x, kind in zip(out[2:], list(fields)[4:])]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(out[1]), pa.array([typed] * len(of)), *rest], schema=fields)

    rows = numbered(rows).select(F.col(carry).cast("long").alias("__key"), "__row", F.col("text").cast("string"))
    found = rows.mapInArrow(scan, "__key long, __row long, template long, typed boolean, length long, place long, slots array<long>, counts boolean, windows long, eligible long")
    return found.withColumnRenamed("__key", carry)


def _bits(built: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array; at most ``bits / 64`` rows come to the driver."""
    rows = built.toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["__word"].to_numpy(np.int64)] = rows["__bits"].to_numpy(np.int64).view(np.uint64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """One row per leak: doc_id, item_id, __row (the document's place), matched_windows, item_windows, changed_slots."""
    docs = numbered(docs)
    items = materialise(windows(benchmark, "item_id", {False: [window], True: [window]}, literals, items=True), "items")
    bits = _bits(bitfilter.build(items, F.col("template"), FILTER_BITS), FILTER_BITS)
    # two forms and ``window`` lengths at most
    known = items.select("typed", "length").distinct().collect()
    lengths = {typed: sorted({r["length"] for r in known if r["typed"] == typed}, reverse=True) for typed in (False, True)}
    found = windows(docs, "doc_id", lengths, literals, only=bits).select("doc_id", "__row", "template", "typed", "length", "place", "slots")
    items = items.select("item_id", F.col("__row").alias("__item"), "template", "typed", "length", F.col("place").alias("__at"), F.col("slots").alias("__slots"), "windows", "eligible")
    joined = found.join(items, ["template", "typed", "length"]).withColumn("__shift", F.col("place") - F.col("__at"))
    window_of = F.struct("place", F.arrays_zip(F.col("__slots").alias("item"), F.col("slots").alias("doc")).alias("pairs"))
    keys = ["__row", "doc_id", "__item", "item_id", "typed", "__shift", "windows", "eligible"]
    aligned = joined.groupBy(*keys).agg(F.collect_set(window_of).alias("__found"), F.count_distinct("place").alias("n"))
    need = F.when(~F.col("typed"), F.least(F.col("windows") * coverage, F.lit(run))).when(F.col("eligible") < 0, -F.col("eligible")).otherwise(F.least(F.col("eligible") * coverage, F.lit(run)))
    # stored, since both forms are taken from it and documents shall be read once
    aligned = materialise(aligned.filter((F.col("n") > 0) & (F.col("n") >= need)).withColumn("need", need.cast("double")), "aligned")
    literal = aligned.filter("NOT typed").select(*keys[:4], "n", F.lit(0).cast("long").alias("same"), F.col("windows").alias("of"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                out = [judge(found, need) for found, need in zip(part.column("__found").to_pylist(), part.column("need").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array([x and x[i] for x in out], pa.int64()) for i in range(2)), part.column("of")], names=[*keys[:4], "n", "same", "of"])

    typed = aligned.filter("typed").select(*keys[:4], F.abs("eligible").alias("of"), "need", "__found")
    judged = typed.mapInArrow(decide, "__row long, doc_id long, __item long, item_id long, n long, same long, of long").filter("n IS NOT NULL")
    best = literal.unionByName(judged).groupBy(*keys[:4]).agg(F.max(F.struct("n", "same", "of")).alias("__best"))
    return best.select(*keys[:4], F.col("__best.n").alias("matched_windows"), F.col("__best.of").alias("item_windows"), (-F.col("__best.same")).alias("changed_slots"))


def judge(found: list[dict], need: float) -> tuple[int, int] | None:
    """(windows that count, minus the changed slots) of a typed alignment, if they are as many as needed."""
    places: dict[int, set] = {}
    for window in found:
        places.setdefault(window["place"], set()).update((p["item"], p["doc"]) for p in window["pairs"])
    votes = Counter(pair for pairs in places.values() for pair in pairs)
    stands: dict[int, int] = {}
    for (item, doc), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0][1])):
        stands.setdefault(item, doc)
    agree = [pairs for pairs in places.values() if all(stands[a] == b for a, b in pairs) or all(a == b for a, b in pairs)]
    changed = {(a, b) for pairs in agree for a, b in pairs if a != b}
    return (len(agree), -len(changed)) if agree and len(agree) >= need else None


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    docs, names = free_names(docs)
    columns, docs = docs.columns, numbered(docs)
    dropped = materialise(leaks(docs, benchmark).select("__row").distinct(), "dropped")
    return bitfilter.without(docs, dropped, "__row").select(columns).toDF(*names)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_windows", "item_windows", "changed_slots")
