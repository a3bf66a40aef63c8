"""Runs of texts, and hashes of spans in texts beyond every run and table size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from framelake.llm import arrowtext, ngram_join


def test_runs_cover_all_rows_in_order():
    texts = ["a", None, "", "x" * 700_000, "é" * 10, *["short"] * 90_000, "y" * 300_000]
    for column in (pa.array(texts), pa.array(texts).slice(2), pa.array([], pa.string())):
        want, at = [t or "" for t in column.to_pylist()], 0
        for a, b, data, offsets in arrowtext.text_runs(column):
            assert a == at and b > a and offsets[0] == 0 and offsets[-1] == len(data) and len(offsets) == b - a + 1
            assert b - a == 1 or len(data) <= arrowtext.RUN
            raw = data.tobytes()
            assert [raw[x:y].decode() for x, y in zip(offsets, offsets[1:])] == want[a:b]
            at = b
        assert at == len(want)


def test_hashes_in_very_long_texts():
    """Longer than the tables of powers that are kept."""
    data = np.frombuffer(b"0123456789abcdef" * (1 << 19), np.uint8)
    prefix = arrowtext.prefix_hashes(arrowtext.BYTE_VALUE[data])
    start = np.array([0, 16, 1 << 22, len(data) - 160])
    hashes = arrowtext.span_hashes(prefix, start, start + 100)
    assert len(set(hashes.tolist())) == 1
    assert arrowtext.span_hashes(prefix, np.array([1]), np.array([101]))[0] != hashes[0]


def test_sets_of_a_text_do_not_depend_on_its_run():
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    alone = list(ngram_join._sets(pa.array([long]), 5))[0]
    among = list(ngram_join._sets(pa.array(["a b c d e f", long, None, "a b"]), 5))
    assert np.array_equal(among[1], alone) and [len(x) for x in among] == [2, len(alone), 0, 1]


def test_hashes_tell_words_apart_that_polynomials_modulo_a_power_of_two_do_not():
    from framelake.llm import arrowtext

    from .test_packing import SWAPPED, THUE_MORSE

    data = np.frombuffer((THUE_MORSE + THUE_MORSE.translate(SWAPPED) + THUE_MORSE).encode(), np.uint8)
    n = len(THUE_MORSE)
    start, end = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
    for hashes in (arrowtext.word_hashes(data, start, end), arrowtext.prime_hashes(data, start, end)):
        assert hashes[0] == hashes[2] != hashes[1]


def test_prime_hashes_equal_whole_numbers():
    from framelake.llm import arrowtext

    prime, base = (1 << 61) - 1, arrowtext._PRIME_BASE
    data = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    start = np.random.default_rng(3).integers(0, 4000, 200)
    end = start + np.random.default_rng(4).integers(0, 1000, 200)
    found = arrowtext.prime_hashes(data, start, end).tolist()
    for h, a, b in zip(found, start.tolist(), end.tolist()):
        assert h == sum((int(x) + 1) * pow(base, k, prime) for k, x in enumerate(data[a:b])) % prime ^ ((b - a) << 61) & ((1 << 64) - 1)
