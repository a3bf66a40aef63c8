"""Arithmetic of probabilities, quantisers, loop filters and small kernels as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cursor import bind

#: The half-sample taps of the regular interpolation filter.
HALF_SAMPLE = [-1, 6, -19, 78, 78, -19, 6, -1]


def clip(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round2(x: Column, n: int) -> Column:
    """x / 2**n, halves up."""
    return F.shiftright(x + (1 << (n - 1)), n) if n else x


def merge_probability(before: Column, zeros: Column, ones: Column, saturation: int, rate: int) -> Column:
    """A probability moved towards what was counted, the more so the more was counted."""
    n = zeros + ones
    seen = F.when(n == 0, F.lit(128)).otherwise(clip(F.floor((256 * zeros + F.floor(n / 2)) / F.nullif(n, F.lit(0))), 1, 255))
    factor = F.floor(rate * F.least(n, F.lit(saturation)) / saturation)
    return F.floor((before * (256 - factor) + seen * factor + 128) / 256).cast("long")


def inverse_remap(delta: Column, probability: Column) -> Column:
    """The probability that a coded difference stands for.

    The first 20 differences are coarse steps of 13 from 7; the others are the
    remaining values in order.
    """
    fine = delta - 20
    # the fine values skip 7, 20, 33, ...: 12 stand between two coarse ones, 6 before the first
    spread = F.when(fine < 6, fine + 1).otherwise(fine + 2 + F.floor((fine - 6) / 12))
    value = F.when(delta < 20, 7 + 13 * delta).otherwise(spread)

    def recentre(m: Column) -> Column:
        odd = value % 2 == 1
        return F.when(value > 2 * m, value).when(odd, m - F.floor((value + 1) / 2)).otherwise(m + F.floor(value / 2))

    below = probability - 1
    return F.when(2 * below <= 254, 1 + recentre(below)).otherwise(255 - recentre(254 - below)).cast("long")


def segment_quantiser(base: Column, enabled: Column, absolute: Column, data: Column) -> Column:
    """The quantiser index of a segment."""
    return F.when(enabled & absolute, clip(data, 0, 255)).when(enabled, clip(base + data, 0, 255)).otherwise(base)


def filter_level(frame: Column, segment: Column, enabled: Column, reference: Column, mode: Column) -> Column:
    """Loop-filter level with reference and mode deltas, which the frame's level scales."""
    shift = F.floor(frame / 32)
    return F.when(enabled, clip(segment + (reference + mode) * F.pow(F.lit(2), shift).cast("long"), 0, 63)).otherwise(segment)


def filter_limits(level: Column, sharpness: Column) -> tuple[Column, Column, Column]:
    """(limit, blimit, thresh) of a level."""
    shift = F.when(sharpness > 4, 4).when(sharpness > 0, 2).otherwise(1)
    shifted = F.floor(level / shift)
    limit = F.greatest(F.when(sharpness > 0, F.least(shifted, 9 - sharpness)).otherwise(shifted), F.lit(1))
    return limit, 2 * (level + 2) + limit, F.floor(level / 16)


def walsh_hadamard(a: Column, c: Column, d: Column, b: Column) -> list[Column]:
    """One pass of the inverse 4-point transform, by lifting."""
    a, d = a + c, d - b
    e = F.shiftright(a - d, 1)
    b, c = e - b, e - c
    return [a - b, b, c, d + c]


def true_motion(left: Column, above: Column, corner: Column) -> Column:
    return clip(left + above - corner, 0, 255)


def interpolate(samples: Column, at: int, taps: list[int] = HALF_SAMPLE) -> Column:
    """An 8-tap filter over an array of samples from index ``at``, rounded and clipped to a byte."""
    total = sum((samples[at + k] * tap for k, tap in enumerate(taps)), F.lit(0))
    return clip(round2(total, 7), 0, 255)


def filter_mask(samples: Column, limit: Column, blimit: Column, thresh: Column) -> tuple[Column, Column, Column]:
    """(hev, filter, flat) of the 8 samples p3 p2 p1 p0 q0 q1 q2 q3 across an edge."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (samples[i] for i in range(8))
    steps = [F.abs(x - y) for x, y in ((p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2))]
    hev = F.greatest(F.abs(p1 - p0), F.abs(q1 - q0)) > thresh
    inside = (F.greatest(*steps) <= limit) & (F.abs(p0 - q0) * 2 + F.floor(F.abs(p1 - q1) / 2) <= blimit)
    flat = F.greatest(*[F.abs(x - y) for x, y in ((p1, p0), (q1, q0), (p2, p0), (q2, q0), (p3, p0), (q3, q0))]) <= 1
    return hev, inside, flat


def cpu_list(text: Column) -> Column:
    """Sorted numbers of a list such as ``0-3,5``."""
    each = F.transform(F.split(text, ","), lambda part: F.sequence(F.split(part, "-")[0].cast("int"), F.element_at(F.split(part, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def cpu_mask(cpus: Column) -> Column:
    return F.aggregate(cpus, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.expr("1L") * F.pow(F.lit(2), c).cast("long")))


def average2(a: Column, b: Column) -> Column:
    return F.shiftright(a + b + 1, 1)


def average3(a: Column, b: Column, c: Column) -> Column:
    return F.shiftright(a + 2 * b + c + 2, 2)


def merge_tree(before: Column, counts: Column, tree: list[int], saturation: int = 20, rate: int = 128) -> Column:
    """Probabilities of a binary tree's nodes moved towards the counts of its leaves.

    ``tree`` has two entries for each node: an entry above 0 is the place of
    another node's entries, any other is minus the number of a leaf.  A node's
    counts are the sums of the leaves below its two sides, held to 32 bits.
    """

    def total(entry: int) -> Column:
        if entry <= 0:
            return counts[-entry]
        return F.least(total(tree[entry]) + total(tree[entry + 1]), F.lit((1 << 32) - 1))

    nodes = range(0, len(tree), 2)
    return F.array(*[merge_probability(before[k // 2], total(tree[k]), total(tree[k + 1]), saturation, rate) for k in nodes])


def merge_counts(rows: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counts of all workers added up, held to 32 bits; Spark adds them on the map side first."""
    return rows.groupBy(*key).agg(F.least(F.sum(count), F.lit((1 << 32) - 1)).cast("long").alias(count))


def table_entry(index: Column, table: Column) -> Column:
    """The entry of a quantiser table (an array of 256 numbers) at a clipped index."""
    return table[clip(index, 0, 255).cast("int")]


def dequantise(coefficients: Column, dc: Column, ac: Column, shift: int = 0) -> Column:
    """Coefficients times their quantiser, divided by 2**shift towards 0; null where a coefficient has no 16 bits."""
    scaled = F.transform(coefficients, lambda x, i: F.when(F.abs(x) < 1 << 15, (x * F.when(i == 0, dc).otherwise(ac)).cast("long")))
    return F.transform(scaled, lambda x: F.when(x < 0, -F.shiftright(-x, shift)).otherwise(F.shiftright(x, shift)))


def add_residual(prediction: Column, residual: Column) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clip(p + r, 0, 255))


def walsh_hadamard_block(block: Column) -> Column:
    """Inverse transform of a 4x4 block (16 numbers by rows): rows with a shift of 2, then columns."""
    at = lambda a, k: a[k]
    rows = [x for r in range(4) for x in walsh_hadamard(*[F.shiftright(at(block, 4 * r + c), 2) for c in range(4)])]
    once = F.array(*rows)
    # a lambda binds the first pass, so that it is computed once
    columns = lambda b: [walsh_hadamard(*[b[4 * r + c] for r in range(4)]) for c in range(4)]
    twice = lambda b: (lambda done: F.array(*[done[c][r] for r in range(4) for c in range(4)]))(columns(b))
    return F.element_at(F.transform(F.array(once), twice), 1)


#: The prediction modes in their order.
MODES = ["DC", "V", "H", "D45", "D135", "D117", "D153", "D207", "D63", "TM"]


def predict(mode: str, above: Column, left: Column, corner: Column, size: int, have_above: bool = True, have_left: bool = True, kind: str | None = None) -> Column:
    """The samples of a block by rows, predicted from the edge.

    ``above`` has 2 * size samples, ``left`` has size.  Directional modes read
    one edge that runs from the lowest left sample over the corner to the right.
    With ``kind`` samples are of that type; those that repeat are cast once.
    """
    n = size
    cast = lambda x: x if kind is None else x.cast(f"array<{kind}>")
    if mode == "DC":
        if not (have_above or have_left):
            return cast(F.array_repeat(F.lit(128).cast("long"), n * n))
        edge = ([F.slice(above, 1, n)] if have_above else []) + ([left] if have_left else [])
        edge = F.concat(*edge)
        count = n * (have_above + have_left)
        mean = F.floor((F.aggregate(edge, F.lit(0).cast("long"), lambda a, x: a + x) + count // 2) / count).cast("long")
        return cast(F.array_repeat(mean, n * n))
    if mode == "V":
        return F.flatten(F.array_repeat(cast(F.slice(above, 1, n)), n))
    if mode == "H":
        return F.flatten(F.transform(cast(F.slice(left, 1, n)), lambda x: F.array_repeat(x, n)))
    if mode == "TM":
        steps = F.transform(F.slice(left, 1, n), lambda x: x - corner)
        return cast(bind(F.slice(above, 1, n), lambda a: F.flatten(F.transform(steps, lambda d: F.transform(a, lambda x: clip(x + d, 0, 255))))))

    # along a direction samples repeat from row to row: each row is a part of a line that is worked out once
    def line(first: int, last: int, of: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(last)), of)

    def rows(lines: Column, begin: Callable[[Column], Column]) -> Column:
        return bind(cast(lines), lambda x: F.flatten(line(0, n - 1, lambda r: F.slice(x, begin(r), n))))

    def pairs(even: Column, odd: Column, begin: Callable[[Column], Column]) -> Column:
        """Rows in turn from a line for even rows and one for odd ones, which begin at the same place in both."""
        of = lambda x: line(0, n // 2 - 1, lambda q: F.flatten(F.array(F.slice(x["even"], begin(q), n), F.slice(x["odd"], begin(q), n))))
        return bind(F.struct(cast(even).alias("even"), cast(odd).alias("odd")), lambda x: F.flatten(of(x)))

    two = lambda e: lambda k: average2(e[k], e[k + 1])
    three = lambda e: lambda k: average3(e[k], e[k + 1], e[k + 2])
    half = lambda k: F.shiftright(k, 1)
    if mode == "D45":
        return bind(above, lambda a: rows(F.concat(line(0, 2 * n - 3, three(a)), F.array(a[2 * n - 1])), lambda r: r + 1))
    if mode == "D63":
        most = n // 2 + n - 2
        return bind(above, lambda a: pairs(line(0, most, two(a)), line(0, most, three(a)), lambda q: q + 1))
    if mode == "D207":

        def downwards(l: Column) -> Column:  # noqa: E741
            last = l[n - 1]
            long = F.concat(F.slice(l, 1, n), F.array(last, last))
            return bind(long, lambda e: rows(F.concat(line(0, 2 * n - 3, lambda k: F.when(k % 2 == 0, two(e)(half(k))).otherwise(three(e)(half(k)))), F.array_repeat(last, n)), lambda r: 2 * r + 1))

        return bind(left, downwards)
    # the edge with the corner at place n: left samples count down before it, above ones up after it
    edge = F.concat(F.reverse(F.slice(left, 1, n)), F.array(corner), F.slice(above, 1, n))
    if mode == "D135":
        return bind(edge, lambda e: rows(line(0, 2 * n - 2, three(e)), lambda r: n - r))
    if mode == "D117":
        # before place 0 stands what the left edge feeds, two samples farther for each
        q = n // 2 - 1
        before = lambda e, by: [line(-q, -1, lambda k: three(e)(n + 2 * k - by))] if q else []
        even = lambda e: F.concat(*before(e, 0), line(0, n - 1, lambda k: two(e)(n + k)))
        odd = lambda e: F.concat(*before(e, 1), line(0, n - 1, lambda k: three(e)(n + k - 1)))
        return bind(edge, lambda e: pairs(even(e), odd(e), lambda r: q + 1 - r))
    if mode == "D153":
        low = 2 * (n - 1)

        def sideways(e: Column) -> Column:
            flat = lambda k: F.when(k % 2 == 0, two(e)(n - 1 + half(k))).otherwise(three(e)(n - 1 + half(k - 1)))
            return rows(F.concat(line(-low, 1, flat), line(2, n - 1, lambda k: three(e)(n + k - 2))), lambda r: low + 1 - 2 * r)

        return bind(edge, sideways)
    raise ValueError(mode)


def bilinear_taps(phase: int) -> list[int]:
    """The two-sample filter at a sixteenth-sample phase, as 8 taps."""
    return [0, 0, 0, 128 - 8 * phase, 8 * phase, 0, 0, 0]


def interpolate_block(samples: Column, stride: int, width: int, height: int, across: list[int] | Column, down: list[int] | Column) -> Column:
    """A separable 8-tap filter: ``height`` + 7 rows are filtered across, rounded and clipped, then down.

    ``samples`` are by rows of ``stride`` (at least ``width`` + 7) samples.  Taps
    are numbers, or an array column where the phase differs from row to row.
    """
    terms = lambda taps: [(k, taps[k]) for k in range(8)] if isinstance(taps, Column) else [(k, t) for k, t in enumerate(taps) if t]
    pick = lambda a, at, step, taps: clip(round2(sum((a[at + k * step] * t for k, t in terms(taps)), F.lit(0)), 7), 0, 255)
    rows = F.transform(F.sequence(F.lit(0), F.lit((height + 7) * width - 1)), lambda k: pick(samples, (F.floor(k / width) * stride + k % width).cast("int"), 1, across))
    columns = lambda b: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: pick(b, k.cast("int"), width, down))
    return F.element_at(F.transform(F.array(rows), columns), 1)


def flat_far(samples: Column) -> Column:
    """Whether the outer samples of the 16 across an edge (p7 to p0, q0 to q7) are close to the inner ones."""
    p0, q0 = samples[7], samples[8]
    return F.greatest(*[F.abs(samples[k] - p0) for k in range(4)], *[F.abs(samples[k] - q0) for k in range(12, 16)]) <= 1


def _byte(x: Column) -> Column:
    return clip(x, -128, 127)


def narrow_filter(samples: Column, hev: Column) -> Column:
    """(p1, p0, q0, q1) after the narrow filter of an edge."""
    p1, p0, q0, q1 = (samples[k] - 128 for k in range(4))
    base = _byte(F.when(hev, _byte(p1 - q1)).otherwise(0) + 3 * (q0 - p0))
    first, second = F.shiftright(_byte(base + 4), 3), F.shiftright(_byte(base + 3), 3)
    outer = F.when(hev, 0).otherwise(F.shiftright(first + 1, 1))
    return F.array(_byte(p1 + outer) + 128, _byte(p0 + second) + 128, _byte(q0 - first) + 128, _byte(q1 - outer) + 128)


def wide_filter(samples: Column, log2_size: int) -> Column:
    """The samples that the wide filter of 2**log2_size taps changes, of the 2n + 2 across an edge (n = 3 or 7)."""
    n = (1 << log2_size - 1) - 1
    at = lambda i: samples[min(max(i, -(n + 1)), n) + n + 1]
    return F.array(*[clip(round2(at(i) + sum((at(i + j) for j in range(-n, n + 1)), F.lit(0)), log2_size), 0, 255) for i in range(-n, n)])


def transform_type(plane: Column, size_index: Column, lossless: Column, inter: Column, mode: Column) -> Column:
    """Which transform a block has: only intra luma below 32x32 departs from the cosine one, by its mode."""
    by_mode = F.when(mode.isin("V", "D117", "D63"), "ADST_DCT").when(mode.isin("H", "D153", "D207"), "DCT_ADST").when(mode.isin("D135", "TM"), "ADST_ADST").otherwise("DCT_DCT")
    return F.when((plane > 0) | (size_index == 3) | lossless | inter, "DCT_DCT").otherwise(by_mode)


def edge_filter_size(size_index: Column, on_32: Column, vertical: Column, chroma: Column, x: Column, y: Column, mi_cols: Column, mi_rows: Column) -> Column:
    """Index of the filter at an edge: 8 for a 4x4 transform on a 32 edge, 16 at most, 8 where chroma meets the last column or row."""
    base = F.when((size_index == 0) & on_32, 1).otherwise(F.least(size_index, F.lit(2)))
    last = F.when(vertical, F.shiftright(x, 3) == mi_cols - 1).otherwise(F.shiftright(y, 3) == mi_rows - 1)
    return F.when((base == 2) & chroma & last, 1).otherwise(base)


def block_edge(vertical: Column, x: Column, y: Column, units_wide: Column, units_high: Column) -> Column:
    """Whether a place in samples is on a block's left edge (vertical filters) or its upper one; blocks are powers of two of 8 samples."""
    return F.when(vertical, x % (8 * units_wide) == 0).otherwise(y % (8 * units_high) == 0)


def transform_edge(vertical: Column, edge: Column, x: Column, size_index: Column, chroma: Column, mi_cols: Column, luma_cols: Column) -> Column:
    """Whether edge number ``edge`` (in units of 4 samples) is a transform's; odd chroma columns have none at the right of a row."""
    odd = ~vertical & chroma & (mi_cols % 2 == 1) & (edge % 2 == 1) & (x + 8 >= luma_cols)
    return ~odd & (edge % F.pow(F.lit(2.0), size_index).cast("long") == 0)


def round_vector(total: Column, count: int) -> Column:
    """The mean of 2 or 4 vector components, halves away from 0."""
    half = count // 2
    return F.when(total < 0, -F.floor((half - total) / count)).otherwise(F.floor((total + half) / count)).cast("long")


def lower_precision(component: Column) -> Column:
    """An odd component moved by one towards 0."""
    return component - F.when(component % 2 != 0, F.signum(component)).otherwise(0).cast("long")


def high_precision(row: Column, column: Column) -> Column:
    """Whether a vector is short enough for an eighth of a sample."""
    return (F.shiftright(F.abs(row), 3) < 8) & (F.shiftright(F.abs(column), 3) < 8)


def clamp_vector(component: Column, place: Column, units: Column, total: Column, border: int) -> Column:
    """A vector component held to the frame and a border; places are in units of 8 samples."""
    return F.least(F.greatest(component, -(place * 64) - border), (total - units - place) * 64 + border)


def reference_scale(reference: Column, size: Column) -> Column:
    """A reference's size relative to the frame's, with 14 bits of fraction."""
    return F.floor(reference * (1 << 14) / size).cast("long")


def scaled_place(place: Column, scale: Column) -> Column:
    return F.shiftright(place * scale, 14)


def compound_references(last: Column, golden: Column, alternate: Column) -> Column:
    """Struct (fixed, first, second) of a compound prediction, by the signs of the three references."""
    three = lambda *names: F.struct(*[F.lit(n).alias(k) for n, k in zip(names, ("fixed", "first", "second"))])
    return F.when(last == golden, three("altref", "last", "golden")).when(last == alternate, three("golden", "last", "altref")).otherwise(three("last", "golden", "altref"))


def reference_mode(last: Column, golden: Column, alternate: Column, compound: Column, select: Column) -> Column:
    """single, compound or select: the two coded bits count only where the references' signs differ."""
    return F.when((golden == last) & (alternate == last) | ~compound, "single").when(select, "select").otherwise("compound")


def interpolation(switchable: Column, literal: Column) -> Column:
    return F.when(switchable, "switchable").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("smooth", "regular", "sharp", "bilinear")]), (literal + 1).cast("int")))


def coefficient_band(size_index: Column, place: Column) -> Column:
    """The band of a coefficient by its place in the scan."""
    first = F.when(place < 1, 0).when(place < 3, 1).when(place < 6, 2).when(place < 10, 3)
    return F.when(size_index == 0, first.when(place < 13, 4).otherwise(5)).otherwise(first.when(place < 21, 4).otherwise(5))


def interpolated_row(probability: Column, table: Column, column: int) -> Column:
    """A tail probability: odd probabilities have a row in ``table``, even ones the mean of two; 0 is invalid."""
    low = F.floor((probability - 1) / 2).cast("int")
    at = lambda row: table[row][column]
    return F.when(probability > 0, F.when(probability % 2 == 1, at(low)).otherwise(F.shiftright(at(low) + at(F.least(low + 1, F.size(table) - 1)), 1)))


def first_two(values: Column) -> Column:
    """The first two distinct entries, in order."""
    return F.slice(F.array_distinct(values), 1, 2)
