"""Inverse cosine and sine transforms as networks of butterflies over arrays.

A network is a list of stages; a stage gives, for each of its outputs, the
inputs that it adds up, with their factors, and whether the sum is rounded to
14 bits below.  Each stage is one array, bound once, so an expression grows
with n log n.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cursor import bind

#: An output: ((input, factor), …) and whether to round.
Output = tuple[tuple[tuple[int, int], ...], bool]


def _cos(k: int) -> int:
    """Cosine of k/64 of half a turn in 14 bits."""
    return round(math.cos(k * math.pi / 64) * (1 << 14))


def _sin9(k: int) -> int:
    """Sine of k ninths of half a turn, times the square root of 8/9, in 14 bits."""
    return round(math.sin(k * math.pi / 9) * math.sqrt(8) / 3 * (1 << 14))


def _pass(i: int) -> Output:
    return ((i, 1),), False


def _sum(*terms: tuple[int, int], rounded: bool = False) -> Output:
    return terms, rounded


def _beside(left: list[list[Output]], right: list[list[Output]], at: int) -> list[list[Output]]:
    """Two networks side by side; the shorter one waits."""
    n = max(len(left), len(right))
    widths = len(left[0]), len(right[0])
    fill = [left + [[_pass(i) for i in range(widths[0])]] * (n - len(left)), right + [[_pass(i) for i in range(widths[1])]] * (n - len(right))]
    return [a + [(tuple((i + at, f) for i, f in terms), rounded) for terms, rounded in b] for a, b in zip(*fill)]


def _reversed_bits(i: int, n: int) -> int:
    return int(f"{i:0{n.bit_length() - 1}b}"[::-1], 2) if n > 1 else 0


def _odd_half(m: int) -> list[list[Output]]:
    """From the odd coefficients, in bit-reversed order, of a transform of 2 * m points."""
    turn = [_pass(i) for i in range(m)]
    for i in range(m // 2):
        # what stands at the mirrored place is the coefficient that completes this one to 2 * m
        j, a = m - 1 - i, 16 * (2 * _reversed_bits(i, m) + 1) // m
        turn[i], turn[j] = _sum((i, _cos(32 - a)), (j, -_cos(a)), rounded=True), _sum((i, _cos(a)), (j, _cos(32 - a)), rounded=True)
    stages = [turn]
    g = 2
    while g < m:
        add = []
        for i in range(m):
            o, odd = i % g, i // g % 2 == 1
            add.append(_sum((i - o + g - 1 - o, 1), (i, -1 if (o < g // 2) == odd else 1)))
        stages.append(add)
        base, turn = 32 * g // m, [_pass(i) for i in range(m)]
        for i in range(m // 2):
            o, j = i % (2 * g), m - 1 - i
            a = base * (1 + 4 * (i // (2 * g)))
            if g // 2 <= o < g:
                turn[i], turn[j] = _sum((i, -_cos(a)), (j, _cos(32 - a)), rounded=True), _sum((i, _cos(32 - a)), (j, _cos(a)), rounded=True)
            elif g <= o < 3 * g // 2:
                turn[i], turn[j] = _sum((i, -_cos(32 - a)), (j, -_cos(a)), rounded=True), _sum((i, -_cos(a)), (j, _cos(32 - a)), rounded=True)
        stages.append(turn)
        g *= 2
    return stages


@cache
def cosine(n: int) -> list[list[Output]]:
    """The inverse cosine transform of n points: 2, 4, 8, 16 or 32."""
    if n == 2:
        c = _cos(16)
        return [[_sum((0, c), (1, c), rounded=True), _sum((0, c), (1, -c), rounded=True)]]
    m = n // 2
    deal = [_pass(2 * i) for i in range(m)] + [_pass(2 * _reversed_bits(i, m) + 1) for i in range(m)]
    join = [_sum((i, 1), (n - 1 - i, 1)) for i in range(m)] + [_sum((n - 1 - i, 1), (i, -1)) for i in range(m, n)]
    return [deal, *_beside(cosine(m), _odd_half(m), m), join]


def _turns(pairs: list[tuple[int, int, int, int]], n: int) -> list[Output]:
    """For each (a, b, angle, sign): outputs 2k and 2k + 1 of a rotation, not rounded; others pass."""
    out = [_pass(i) for i in range(n)]
    for a, b, angle, sign in pairs:
        c, s = _cos(angle), _cos(32 - angle)
        if sign > 0:
            out[a], out[b] = _sum((a, c), (b, s)), _sum((a, s), (b, -c))
        else:
            out[a], out[b] = _sum((a, -s), (b, c)), _sum((a, c), (b, s))
    return out


def _apart(n: int, width: int, rounded: list[bool]) -> list[Output]:
    """Sums and differences of elements ``width`` apart, in groups of twice that; rounded group by group."""
    out = []
    for i in range(n):
        low, group = i % (2 * width) < width, i // (2 * width)
        out.append(_sum((i, 1), (i + width, 1), rounded=rounded[group]) if low else _sum((i - width, 1), (i, -1), rounded=rounded[group]))
    return out


@cache
def sine(n: int) -> list[list[Output]]:
    """The inverse sine transform of 4, 8 or 16 points."""
    if n == 4:
        a, b, c, d = (_sin9(k) for k in (1, 2, 3, 4))
        # x0 * a + x2 * d + x3 * b, x0 * b - x2 * a - x3 * d, x1 * c, (x0 - x2 + x3) * c
        first = [_sum((0, a), (2, d), (3, b)), _sum((0, b), (2, -a), (3, -d)), _sum((1, c)), _sum((0, c), (2, -c), (3, c))]
        return [first, [_sum((0, 1), (2, 1), rounded=True), _sum((1, 1), (2, 1), rounded=True), _sum((3, 1), rounded=True), _sum((0, 1), (1, 1), (2, -1), rounded=True)]]
    half = _cos(16)
    deal = [_pass(i - 1 if i % 2 else n - 1 - i) for i in range(n)]
    stages = [deal, _turns([(2 * k, 2 * k + 1, (4 * k + 1) * 16 // n, 1) for k in range(n // 2)], n), _apart(n, n // 2, [True])]
    if n == 8:
        stages += [_turns([(4, 5, 8, 1), (6, 7, 8, -1)], n), _apart(n, 2, [False, True])]
        turn = [_pass(i) for i in range(n)]
        for i in (2, 6):
            turn[i], turn[i + 1] = _sum((i, half), (i + 1, half), rounded=True), _sum((i, half), (i + 1, -half), rounded=True)
        order = [(0, 1), (4, -1), (6, 1), (2, -1), (3, 1), (7, -1), (5, 1), (1, -1)]
    else:
        stages += [_turns([(8, 9, 4, 1), (10, 11, 20, 1), (12, 13, 4, -1), (14, 15, 20, -1)], n), _apart(n, 4, [False, True])]
        stages += [_turns([(4, 5, 8, 1), (6, 7, 8, -1), (12, 13, 8, 1), (14, 15, 8, -1)], n), _apart(n, 2, [False, True, False, True])]
        turn = [_pass(i) for i in range(n)]
        for i, (a, b, c, d) in {2: (-1, -1, 1, -1), 6: (1, 1, -1, 1), 10: (1, 1, -1, 1), 14: (-1, -1, 1, -1)}.items():
            turn[i], turn[i + 1] = _sum((i, a * half), (i + 1, b * half), rounded=True), _sum((i, c * half), (i + 1, d * half), rounded=True)
        order = [(0, 1), (8, -1), (12, 1), (4, -1), (6, 1), (14, 1), (10, 1), (2, 1), (3, 1), (11, 1), (15, 1), (7, 1), (5, 1), (13, -1), (9, 1), (1, -1)]
    return [*stages, turn, [_sum(x) for x in order]]


def network(kind: str, n: int) -> list[list[Output]]:
    return cosine(n) if kind == "DCT" else sine(n)


def inverse(values: Column, kind: str, n: int) -> Column:
    """The inverse transform of an array of n whole numbers; ``kind`` is DCT (4 to 32 points) or ADST (4 to 16)."""

    def output(v: Column, terms: tuple[tuple[int, int], ...], rounded: bool) -> Column:
        whole = None
        for i, factor in terms:
            term = v[i] if factor == 1 else -v[i] if factor == -1 else v[i] * factor
            whole = term if whole is None else whole + term
        return F.shiftright(whole + (1 << 13), 14) if rounded else whole

    def run(v: Column, stages: list[list[Output]]) -> Column:
        now = F.array(*[output(v, *o) for o in stages[0]])
        return bind(now, lambda x: run(x, stages[1:])) if stages[1:] else now

    return bind(F.transform(values, lambda x: x.cast("long")), lambda v: run(v, network(kind, n)))


#: Bits below the result of both passes, by size.
_SHIFT = {4: 4, 8: 5, 16: 6, 32: 6}


def inverse_block(values: Column, n: int, across: str = "DCT", down: str = "DCT") -> Column:
    """Residuals of a block of n by n coefficients, row by row: rows first, then columns, then rounding."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: inverse(F.slice(values, r * n + 1, F.lit(n)), across, n))

    def columns(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: inverse(F.transform(rows, lambda row: F.get(row, c)), down, n))

    def turned(columns: Column) -> Column:
        place = F.sequence(F.lit(0), F.lit(n * n - 1))
        sample = lambda k: F.get(F.get(columns, k % n), F.floor(k / n).cast("int"))
        return F.transform(place, lambda k: F.shiftright(sample(k) + (1 << (_SHIFT[n] - 1)), _SHIFT[n]))

    return bind(rows, lambda r: bind(columns(r), turned))
