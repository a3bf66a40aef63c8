"""Exact Jaccard join of documents' word n-gram sets, and its components.

Jaccard distance is a metric, so pivots with triangle-inequality windows split
a join exactly.  Over a whole corpus, though, nearly all distances are 1, and
windows of twice the threshold around pivots would copy nearly every document
into every region.  Distances spread only among documents that have something
in common, so a first split finds those, and the metric join works on them:

1. Sets of a size class are cut into as many parts, by ranges of n-gram hashes,
   as two sets within the threshold may differ in n-grams, and some more.  Then
   those two have at least one whole part in common.  A part is a region if it
   holds an n-gram that is not common in the corpus; a set with too many other
   parts also joins the regions of its rarest n-grams, as many as it may miss,
   and one more.  Sets that share regions, directly or over others, form a
   family.
2. Families are joined.  Crowded ones are split by Spark: several pivots for
   each, every set goes to the Voronoi cell of the nearest one and, by the window
   of twice the threshold, to those cells that it may reach into, and cells that
   are still crowded are split again.  What lies within the threshold of a cell's
   pivot is linked to it and stays only if something farther out may reach it.
   Small families and cells are split in the same way within a task, and compared
   directly in the end.
3. What splits leave crowded is joined region by region if that takes fewer
   pairs, split again, and at last compared in pairs of chunks.

So links connect exactly what they would if all pairs were compared, and a
group of copies gives about as many links as it has texts.

Defined results: null texts are empty; a text without words has an empty set
and links with nothing; fewer words than n make one n-gram of them all;
repeated rows have equal sets and share a component; a null doc_id never is the
smallest unless all are null; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from . import bitfilter
from .arrowtext import MIX, mix, prefix_hashes, span_hashes, text_runs, word_hashes, word_spans
from .components import connected
from .tables import free_names, read

WORDS = 5
PERCENT = 80
#: Places of the sketch that tells common n-grams, and from how many occurrences above the usual one is common.
GRAM_BITS = 20
COMMON = 200
SKETCH_PART = 1 << 12
#: A region or block of more sets or of more n-grams in all is not joined in one task.
REGION_ROWS = 500
REGION_GRAMS = 1 << 21
#: Pairs of a region and a member that a task puts in order.
PART_ROWS = 1 << 20
PIVOTS = 8
ROUNDS = 6

_word_bytes = np.ones(256, bool)
_word_bytes[[32, 9, 10, 11, 12, 13]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _run_grams(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of some texts in order, and where each text's begin and the last one's end."""
    start, end, first = word_spans(data, offsets, _word_bytes)
    prefix = prefix_hashes(word_hashes(_lower[data], start, end))
    size = np.diff(first)
    grams = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], grams)
    return span_hashes(prefix, at, np.minimum(at + words, np.repeat(first[1:], grams))), bounds


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    for _, _, data, offsets in text_runs(column):
        grams, bounds = _run_grams(data, offsets, words)
        for x, y in zip(bounds[:-1], bounds[1:]):
            yield np.unique(grams[x:y])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def gram_weights(docs: DataFrame, words: int) -> np.ndarray:
    """How far each place of a sketch of n-grams stands out from what chance puts into places; 0 is not at all.

    All rows are counted.  Tasks send their counts in parts, the parts' sums are
    made as they stream by, and arrays of fixed size come to the driver.  Weights
    steer the split and decide nothing.
    """
    places = 1 << GRAM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column(0)):
                np.add.at(total, _bucket(_run_grams(data, offsets, words)[0]), 1)
        parts = [total[a : a + SKETCH_PART].tobytes() for a in range(0, places, SKETCH_PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    kind = "part long, counts binary"
    found = docs.select(F.col("text").cast("string")).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toPandas()
    total = np.zeros(places, np.int64)
    for part, counts in zip(found["part"], found["counts"]):
        total[part * SKETCH_PART : (part + 1) * SKETCH_PART] = np.frombuffer(counts, np.int64)
    usual = float(np.median(total))
    excess = np.maximum(total - usual - 4 * usual**0.5, 0)
    return np.where(excess >= COMMON, np.minimum(1 + np.log2(np.maximum(excess, 1)), 255), 0).astype(np.uint8)


def least_overlap(n: int, percent: int) -> int:
    """The fewest common n-grams with any partner of a set of n."""
    return -(-n * percent // 100)


class Parts:
    """The regions of a set: its parts, by size class.

    Classes span a factor of 1 / t**reach in size (t the threshold), so partners
    are in the same class or in neighbouring ones, and a set that may have a
    partner in the class below is entered there too.  Two sets of a class differ
    in at most (1 - t) / t times the class's largest size: by more parts than
    that one is whole in both.  Every further part allows one that says little
    (no n-gram but common ones); a set with more of those than are allowed also
    takes its rarest n-grams, by weight, then hash, one more than may be missing.
    """

    def __init__(self, percent: int, most: int = 1 << 40) -> None:
        self.percent = percent
        t = percent / 100
        step = (1 / t) ** (3 if percent >= 88 else 1)
        self.bounds = [1]
        while self.bounds[-1] < most:
            self.bounds.append(max(self.bounds[-1] + 1, math.ceil(self.bounds[-1] * step)))
        self.parts, self.spare = [], []
        for low, high in zip(self.bounds[:-1], self.bounds[1:]):
            differ = (100 - percent) * (high - 1) // percent
            spare = 0
            if differ:
                idle = (differ + 1) * math.exp(-low / (differ + 1))
                spare = min(math.ceil(idle + 2 * idle**0.5), (differ + 1) // 4)
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)
        self.starts = np.array(self.bounds)

    def classes(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        return [own, own - 1] if own and least_overlap(n, self.percent) < self.bounds[own] else [own]

    def keys(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Regions of a set of sorted n-gram hashes."""
        n, out = len(grams), []
        weight = weights[_bucket(grams)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
        rare = np.concatenate([[0], np.cumsum(weight == 0)])
        for k in self.classes(n):
            m = self.parts[k]
            part = (grams >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)  # grows with the hash
            edge = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
            strong = np.flatnonzero(rare[edge[1:]] > rare[edge[:-1]])
            label = np.uint64(k << 40) + strong.astype(np.uint64)
            out.append(mix((sums[edge[strong + 1]] - sums[edge[strong]]) ^ mix(label * MIX)))
            if m - len(strong) > self.spare[k]:
                first = np.lexsort((grams, weight))[: n - least_overlap(n, self.percent) + 1]
                out.append(mix(grams[first] ^ mix(np.array([(k << 40) + (1 << 39)], np.uint64) * MIX)))
        return np.concatenate(out)


def document_sets(docs: DataFrame, words: int, percent: int, weights: np.ndarray) -> DataFrame:
    """__row, doc_id, n_shingles, set_key and regions of every row; the sets themselves are not stored."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    parts = Parts(percent)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, regions = [], [], []
            for grams in _sets(batch.column(2), words):
                sizes.append(len(grams))
                keys.append(hashlib.md5(grams.tobytes()).digest())
                regions.append(np.unique(parts.keys(grams, shared.value)).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            columns = [pa.array(x, kind) for x, kind in zip((sizes, keys, regions), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["__row", "doc_id", "n_shingles", "set_key", "regions"])

    rows = numbered(docs).select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return materialise(rows.mapInArrow(build, "__row long, doc_id long, n_shingles long, set_key binary, regions array<long>"), "sets")


def shared_regions(sets: DataFrame) -> DataFrame:
    """(region, member, low) of the regions with two different sets at least; a member is the first row of its set, low the least of the region."""
    full = sets.filter("n_shingles > 0")
    # equal sets enter once; a filter lets most rows pass without moving
    first = materialise(full.groupBy("set_key").agg(F.min("__row").alias("__first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    again = materialise(full.select("set_key", "__row").join(first, "set_key").filter("__row <> __first").select("__row"), "again")
    rows = bitfilter.without(full.select("__row", "regions"), again, "__row")
    # nearly every region has one member: they move once, and nothing is kept for each
    tasks = -(-(rows.agg(F.sum(F.size("regions"))).first()[0] or 0) // PART_ROWS) or 1
    pairs = rows.select(F.explode("regions").alias("region"), F.col("__row").alias("member"))
    pairs = pairs.repartition(tasks, "region").sortWithinPartitions("region", "member")
    return materialise(pairs.mapInArrow(_several, "region long, member long, low long"), "members")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, member, low) of the regions with two members at least, from different (region, member) in order."""
    held, told = None, False  # the first pair of the region that may go on, and whether it was passed on
    for batch in batches:
        region, member = (column.to_numpy() for column in batch.columns)
        if not len(region):
            continue
        if held is not None:
            region, member = (np.append(x, y) for x, y in zip(held, (region, member)))
        first = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(first, len(region)))
        kept = np.repeat(size > 1, size)
        kept[0] &= not told
        told = bool(size[-1] > 1) or (told and len(first) == 1)
        held = region[first[-1] : first[-1] + 1], member[first[-1] : first[-1] + 1]
        low = np.repeat(member[first], size)
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (region, member, low)], ["region", "member", "low"])


def _once(members: DataFrame) -> DataFrame:
    """One region for each list of members."""
    h = F.xxhash64("member")
    lists = members.groupBy("region").agg(F.count("*").alias("n"), F.min("member").alias("low"), F.max("member").alias("high"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
    return lists.groupBy("n", "low", "high", "x", "s").agg(F.min("region").alias("region")).select("region")


def _row_key(name: str) -> Column:
    """A key of a row's number, whose upper bits are a file and lower ones a place in it."""
    return F.shiftright(name, 33) * 1000003 + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))


def shingle_sets(docs: DataFrame, rows: DataFrame, name: str, words: int) -> DataFrame:
    """(name, shingles) of the rows of ``docs`` that are in ``rows`` by number, and of few others."""
    built = bitfilter.build(rows, _row_key(name)).toPandas()
    bits = np.zeros(bitfilter.BITS // 64, np.uint64)
    bits[built["__word"].to_numpy(np.int64)] = built["__bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            row = batch.column(0).to_numpy()
            place = ((row >> 33) * 1000003 + (row & ((1 << 33) - 1))) % bitfilter.BITS
            hit = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit))
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([g.tobytes() for g in _sets(some.column(1), words)], pa.binary())], [name, "shingles"])

    return numbered(docs).select(F.col("__row").alias(name), F.col("text").cast("string")).mapInArrow(build, f"{name} long, shingles binary")


def intersections(sets: list[np.ndarray], width: int = 1 << 12, at_once: int = 1 << 18) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by ranges of about ``at_once`` n-grams in all, ``width`` n-grams at a time.

    N-grams of one set alone never count, so they are left out.
    """
    n = len(sets)
    out = np.zeros((n, n), np.float32)  # exact up to 2**24, and no set of one task is larger
    parts = sum(map(len, sets)) // at_once + 1
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(parts):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        owner = np.repeat(np.arange(n), [len(s) for s in some])
        codes, distinct = pd.factorize(np.concatenate(some))
        often = np.bincount(codes, minlength=len(distinct)) > 1
        number = np.cumsum(often) - 1
        kept = often[codes]
        owner, codes = owner[kept], number[codes[kept]]
        order = np.argsort(codes, kind="stable")
        owner, codes = owner[order], codes[order]
        for a in range(0, int(often.sum()), width):
            x, y = np.searchsorted(codes, [a, a + width])
            block = np.zeros((n, width), np.float32)
            block[owner[x:y], codes[x:y] - a] = 1
            out += block @ block.T
    return out.astype(np.int64)


class RegionJoin:
    """Components of the sets of one region, by pivots and windows; exact."""

    def __init__(self, sets: list[np.ndarray], percent: int, direct: int = 24, pivots: int = 4) -> None:
        self.direct, self.pivots, self.threshold = direct, pivots, 1 - percent / 100
        size, both = np.array([len(s) for s in sets]), intersections(sets)
        union = size[:, None] + size[None, :] - both
        self.near = 100 * both >= percent * union
        self.far = 1 - both / union
        self.part = list(range(len(sets)))
        self.found: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.part[i] != i:
            self.part[i] = self.part[self.part[i]]
            i = self.part[i]
        return i

    def link(self, i: int, others: np.ndarray) -> None:
        """Join ``i`` with those of ``others`` that are near it."""
        for j in others[self.near[i, others]].tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.part[max(a, b)] = min(a, b)
                self.found.append((i, j))

    def join(self, members: np.ndarray) -> None:
        if len(members) > self.direct:
            chosen = members[np.linspace(0, len(members) - 1, self.pivots).astype(int)]
            for p in chosen.tolist():
                self.link(p, members[members != p])
            far = self.far[np.ix_(chosen, members)]
            inside = far <= far.min(0) + 2 * self.threshold + 1e-9
            if inside.sum(1).max() <= 0.75 * len(members):
                for row in inside:
                    self.join(members[row])
                return
        for a, i in enumerate(members.tolist()):
            self.link(i, members[a + 1 :])

    def links(self) -> list[tuple[int, int]]:
        self.join(np.arange(len(self.part)))
        return self.found


def distance(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[float, bool]:
    """Jaccard distance of two sorted sets, and whether it is within the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    union = len(a) + len(b) - both
    return 1 - both / union, 100 * both >= percent * union


def _distances(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (…, shingles, __pivots) with ``far``, the distance to each pivot, and ``near``, whether it is within the threshold."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 128):
                some = batch.slice(a, 128)
                far, near = [], []
                for own, others in zip(some.column("shingles"), some.column("__pivots")):
                    own = np.frombuffer(own.as_buffer(), np.uint64)
                    found = [distance(own, np.frombuffer(other.as_buffer(), np.uint64), percent) for other in others]
                    far.append([x for x, _ in found])
                    near.append([y for _, y in found])
                table = some.drop_columns(["__pivots"])
                yield table.append_column("far", pa.array(far, pa.list_(pa.float64()))).append_column("near", pa.array(near, pa.list_(pa.bool_())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__pivots").schema)
    return rows.mapInArrow(measure, f"{schema}, far array<double>, near array<boolean>")


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links inside the regions of ``rows`` (region, member, shingles); a task holds the sets of one region at a time."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, names, sets, found = None, [], [], []

        def told(least: int) -> Iterator[pa.RecordBatch]:
            if len(found) >= least:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
                found.clear()

        def join() -> None:
            if len(names) > 1:
                found.extend((names[i], names[j]) for i, j in RegionJoin(sets, percent).links())

        for batch in batches:
            regions = batch.column(0).to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1], [True]])[: len(regions) + 1]).tolist()
            for a, b in zip(bounds, bounds[1:]):
                if regions[a] != region:
                    join()
                    yield from told(10_000)
                    region, names, sets = regions[a], [], []
                names += batch.column(1).slice(a, b - a).to_pylist()
                sets += [np.frombuffer(x, np.uint64) for x in batch.column(2).slice(a, b - a).to_pylist()]
        join()
        yield from told(0)

    grams = rows.agg(F.sum(F.octet_length("shingles")).alias("n")).first().n or 0
    blocks = -(-grams // (2 * REGION_GRAMS)) or 1
    rows = rows.select("region", "member", "shingles").repartition(blocks, "region").sortWithinPartitions("region", "member")
    return rows.mapInArrow(match, "a long, b long")


def _crowded(rows: DataFrame) -> DataFrame:
    """(region) of those that one task should not join."""
    size = F.sum(F.octet_length("shingles")) > 8 * REGION_GRAMS
    return rows.groupBy("region").agg(((F.count("*") > REGION_ROWS) | size).alias("__crowded")).filter("__crowded").select("region")


def voronoi_cells(rows: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One split of crowded regions: (links to pivots, rows of the cells, rows of the regions that windows cannot split).

    A pivot for each of ``PIVOTS`` shares of a region, the least by hash.  A pair
    within the threshold meets in the cell of the nearest pivot of either: the
    other's distance to it is at most its own nearest one plus twice the
    threshold.  In a cell, sets near the pivot are linked to it, so of them only
    those stay that a set farther out may be linked with.
    """
    threshold = 1 - percent / 100
    order = F.xxhash64("member", F.lit(turn))
    share = F.pmod(F.xxhash64("member", F.lit(-turn - 1)), F.lit(PIVOTS))
    chosen = rows.groupBy("region", share.alias("__share")).agg(F.min_by(F.struct("member", "shingles"), order).alias("p"))
    pivots = chosen.groupBy("region").agg(F.array_sort(F.collect_list("p")).alias("p"))
    pivots = materialise(pivots.select("region", F.col("p.member").alias("__names"), F.col("p.shingles").alias("__pivots")), "pivots")
    measured = materialise(_distances(rows.join(pivots, "region"), percent).drop("shingles"), "measured")
    each = measured.select("region", "member", F.array_min("far").alias("__home"), F.explode(F.arrays_zip("__names", "far", "near")).alias("x"))
    each = each.select("region", "member", "__home", F.col("x.__names").alias("__pivot"), F.col("x.far").alias("__far"), F.col("x.near").alias("__near"))
    links = each.filter("__near AND member <> __pivot").select(F.col("member").alias("a"), F.col("__pivot").alias("b"))
    inside = each.filter(F.col("__far") <= F.col("__home") + 2 * threshold + 1e-9)
    # stored, so that Spark can split a region of many rows in the join
    outside = materialise(inside.filter("NOT __near").groupBy("region", "__pivot").agg(F.min("__far").alias("__nearest")), "outside")
    kept = inside.filter("member <> __pivot").join(outside, ["region", "__pivot"]).filter(F.col("__far") >= F.col("__nearest") - threshold - 1e-9)
    kept = materialise(kept.select("region", "__pivot", "member"), "kept")
    # a split that leaves a cell nearly as large as its region, or copies most sets, is none
    cells = kept.groupBy("region", "__pivot").agg(F.count("*").alias("n")).groupBy("region").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    size = rows.groupBy("region").agg(F.count("*").alias("n"))
    stuck = size.join(cells, "region").filter("most > 0.75 * n OR all > 3 * n").select("region")
    stuck = materialise(stuck, "stuck")
    own = F.xxhash64("region", "__pivot").alias("region")
    split = kept.join(stuck, "region", "left_anti").join(rows, ["region", "member"]).select(own, "member", "shingles")
    return links, materialise(split, "cells"), rows.join(stuck, "region", "left_semi")


def split_and_join(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(links inside the regions of ``rows``, what splits leave crowded or None); ``rows`` (region, member, shingles) are stored."""
    links, left = None, None
    both = lambda a, b: b if a is None else a.unionByName(b)
    for turn in range(ROUNDS):
        crowded = materialise(_crowded(rows), "crowded")
        if not crowded.take(1):
            return both(links, _block_links(rows, percent)), left
        links = both(links, _block_links(rows.join(crowded, "region", "left_anti"), percent))
        near, cells, stuck = voronoi_cells(materialise(rows.join(crowded, "region", "left_semi"), "crowd"), percent, turn)
        links, left, rows = links.unionByName(near), both(left, stuck), cells
    return links, both(left, rows)


def _chunked(rows: DataFrame) -> DataFrame:
    """Regions as all pairs of chunks of bounded size: every two sets meet, however many a region has."""
    size = rows.groupBy("region").agg(F.greatest(F.ceil(F.count("*") * 2 / F.lit(REGION_ROWS)), F.ceil(F.sum(F.octet_length("shingles")) / F.lit(4 * REGION_GRAMS))).cast("int").alias("__chunks"))
    own = rows.join(size, "region").withColumn("__chunk", F.pmod(F.xxhash64("member"), F.col("__chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__other")
    return own.select("*", other).select(F.xxhash64("region", F.least("__chunk", "__other"), F.greatest("__chunk", "__other")).alias("region"), "member", "shingles")


def _by_part(left: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` region by region, rows to be compared as they are): whichever takes fewer pairs for each crowd."""
    place = members.select(F.col("region").alias("__part"), "member").join(left.select("region", "member"), "member")
    place = materialise(place.select(F.col("region").alias("__crowd"), F.xxhash64("region", "__part").alias("region"), "member"), "parts")
    place = place.join(_once(place), "region", "left_semi")
    pairs = place.groupBy("__crowd", "region").agg(F.count("*").alias("n")).groupBy("__crowd").agg(F.sum(F.col("n") * F.col("n")).alias("__pairs"))
    size = left.groupBy("region").agg(F.count("*").alias("n")).withColumnRenamed("region", "__crowd")
    fewer = materialise(size.join(pairs, "__crowd", "left").filter("coalesce(__pairs, 0) < n * n").select("__crowd"), "fewer")
    sets = left.withColumnRenamed("region", "__crowd")
    parted = place.join(fewer, "__crowd", "left_semi").join(sets, ["__crowd", "member"]).select("region", "member", "shingles")
    return parted, left.join(fewer.withColumnRenamed("__crowd", "region"), "region", "left_anti")


def set_links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links between first rows of different sets that connect every component.

    Sets that share regions, directly or over others, form a family, and a
    family is joined as one region, so every set moves once.  What splits leave
    crowded is joined region by region if that takes fewer pairs, and in pairs
    of chunks in the end.
    """
    members = shared_regions(sets)
    families = connected(members.filter("low < member").select(F.col("member").alias("a"), F.col("low").alias("b")).distinct())
    families = materialise(families.select(F.col("root").alias("region"), F.col("node").alias("member")), "families")
    rows = families.join(shingle_sets(docs, families, "member", words), "member").select("region", "member", "shingles")
    links, left = split_and_join(materialise(rows, "rows"), percent)
    if left is not None and left.take(1):
        left = materialise(left, "left")
        parted, whole = _by_part(left, members)
        more, rest = split_and_join(materialise(parted, "parted"), percent)
        links = links.unionByName(more)
        for crowd in (whole, rest):
            if crowd is not None:
                links = links.unionByName(_block_links(materialise(_chunked(crowd), "chunks"), percent))
    return links


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """__row, doc_id, n_shingles, component_id and first (whether the row is its component's first by doc_id, then place)."""
    docs = numbered(docs)
    sets = document_sets(docs, words, percent, gram_weights(docs, words))
    roots = materialise(connected(set_links(docs, sets, words, percent)), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    rows = sets.select("__row", "doc_id", "n_shingles", "set_key")
    by_set = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("__row").alias("node"), F.min(order).alias("__least"))
    by_set = materialise(by_set, "by-set").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_set.groupBy("root").agg(F.min("__least").alias("__least"))
    # both joins are of stored tables, so Spark splits a component or a set that fills a task
    by_set, least = materialise(by_set.select("set_key", "root"), "set-roots"), materialise(least, "least")
    by_set = materialise(by_set.join(least, "root").select("set_key", "__least"), "set-least")
    out = rows.filter("n_shingles > 0").join(by_set, "set_key").select(
        "__row", "doc_id", "n_shingles", F.col("__least.doc_id").alias("component_id"), (F.col("__row") == F.col("__least.row")).alias("first")
    )
    empty = rows.filter("n_shingles = 0").select("__row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(empty)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are their component's first, with all their columns."""
    docs, names = free_names(docs)
    columns, docs = docs.columns, numbered(docs)
    dropped = materialise(groups(docs, words, percent).filter(~F.col("first")).select("__row"), "dropped")
    return bitfilter.without(docs, dropped, "__row").select(columns).toDF(*names)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
