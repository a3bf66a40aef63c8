"""Arrow record batches of texts as numpy arrays, in pieces of bounded size.

Tasks that scan whole texts share these helpers.  A batch is walked in runs of
consecutive rows whose texts add up to about ``limit`` bytes (a longer text is
a run of its own), so temporaries stay small whatever the batch size is.

Spark keeps its Python workers from stage to stage.  So that they do not keep
the memory of the largest stage too, the first walk in a worker makes the C
library give freed blocks of some size back at once, and Arrow use that
allocator; the driver's process stays as it is.

Three hashes: :func:`prefix_hashes` for many overlapping spans, a polynomial
modulo 2**64, under which long texts of a known pattern collide, so it only
steers work or takes values that are hashes already; :func:`word_hashes` for
spans that do not overlap, with an own multiplier for each place; and
:func:`prime_hashes` for overlapping spans, a polynomial modulo 2**61 - 1.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: An odd multiplier and its inverse modulo 2**64, and a mixing constant.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)

#: Bytes of text that are worked on at a time.
RUN = 1 << 18

#: The numbers of mallopt's options for mapped blocks and for the top of the heap.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


_thrifty: list[bool] = []


def give_memory_back() -> None:
    """Set up a worker's allocators, once; elsewhere nothing happens."""
    if _thrifty or TaskContext.get() is None:
        return
    _thrifty.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:  # other C libraries have none
        mallopt(_MMAP_THRESHOLD, 1 << 21)
        mallopt(_TRIM_THRESHOLD, 1 << 24)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, kept between calls up to 2**22."""
    have = _powers.get("base")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        tables = []
        for value in (BASE, BASE_INVERSE):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if size > 1 << 22:
            return tables[0][:n], tables[1][:n]
        _powers["base"], _powers["inverse"] = tables
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One 64-bit value for each byte, made from a rule.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """``h[i]``: polynomial hash of the first ``i`` values, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` that depend on those values alone."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * MIX)


_PRIME = np.uint64((1 << 61) - 1)
#: A place below the prime that its powers start from, made from a rule.
_PRIME_BASE = int(BASE) % ((1 << 61) - 1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that do not overlap: each place within a span has a multiplier of its own."""
    size = end - start
    ends = np.cumsum(size)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    factors = mix((np.arange(int(size.max()) if len(size) else 0, dtype=np.uint64) + np.uint64(1)) * MIX) | np.uint64(1)
    terms = BYTE_VALUE[data[np.repeat(start, size) + within]] * factors[within]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64) * MIX)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` below 2**64 modulo 2**61 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it."""
    low = np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = ah * bl + al * bh
    return _reduced(_reduced(((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))) + _reduced(al * bl))


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept between calls."""
    if len(_powers.get("prime", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, value in (("prime", _PRIME_BASE), ("prime-inverse", pow(_PRIME_BASE, -1, int(_PRIME)))):
            table = np.ones(size, np.uint64)
            have = 1
            while have < size:
                table[have : 2 * have] = _times(table[:have], np.full(have, pow(value, have, int(_PRIME)), np.uint64))[: size - have]
                have *= 2
            _powers[name] = table
    return _powers["prime"][:n], _powers["prime-inverse"][:n]


def prime_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes modulo 2**61 - 1 of any spans of fewer than 2**24 bytes, their lengths included.

    Products of bytes with both halves of a power are summed up, and sums over a
    span are differences of whole numbers, so only spans are reduced.
    """
    up, down = _prime_powers(len(data) + 1)
    low, high = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    np.cumsum(value * (up[: len(data)] & np.uint64((1 << 31) - 1)), out=low[1:])
    np.cumsum(value * (up[: len(data)] >> np.uint64(31)), out=high[1:])
    over = _times(_reduced(high[end] - high[start]), np.full(len(start), 1 << 31, np.uint64))
    sums = _reduced(_reduced(low[end] - low[start]) + over)
    return _times(sums, down[start]) ^ ((end - start).astype(np.uint64) << np.uint64(61))


def text_runs(column: pa.Array, limit: int = RUN, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows, ``rows`` at most; null texts are empty.

    ``offsets`` has one entry more than the run has rows and starts at 0.
    """
    give_memory_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, n if rows is None else at + rows, n)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) of maximal runs of word bytes of one class.

    ``is_word`` is a table of 256 booleans, or of classes where 0 is no word.
    Runs never cross a document; the third array has one entry for each entry
    of ``offsets``.
    """
    kind = is_word[data]
    inside, change = kind != 0, kind[1:] != kind[:-1]
    first = inside.copy()
    first[1:] &= change
    breaks = offsets[:-1][offsets[:-1] < len(data)]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= change
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)
