"""Importance resampling and fill-in-the-middle against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Regex, pre_tokenizers

from framelake.llm import fill_in_middle, importance
from framelake.llm import queries as llm
from framelake.llm.arrowtext import text_runs

from .test_operators import SF, _folder

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = ["Alpha", "beta", "naïve", "7", "ÀÉ", "中文字", "x" * 30, "y" * 49, "z" * 300, "o'clock", "a_b"]
TEXTS = [None, "", "  \n", "a", "Hello World  foo", *[" ".join(WORDS[(i * j + j) % 11] for j in range(i * 3)) for i in range(1, 40)]]
TEXTS += [TEXTS[20]] * 5 + ["\x00 b\x7fc", "é" * 500]


@pytest.fixture(scope="module")
def varied(tmp_path_factory):
    return _folder(tmp_path_factory, TEXTS)


def _features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_features_equal_zlib():
    for first, end, data, offsets in text_runs(pa.array(TEXTS, pa.string()), 2000):
        place, owner, words = importance.features(data, offsets)
        for i in range(end - first):
            n, want = _features(TEXTS[first + i])
            assert words[i] == n and sorted(place[owner == i].tolist()) == sorted(want)


@pytest.mark.parametrize("folder", ["varied", SF])
def test_resampling_equals_a_plain_version(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "varied" else folder
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    s = Counter(x for _, text in docs for x in _features(text)[1])
    t = Counter(x for text in target for x in _features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    want = []
    for doc_id, text in docs:
        n, found = _features(text)
        weight = sum(gain[x] for x in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = {r[0]: k for k, r in enumerate(enough[: 5 * len(enough) // 100], 1)}
    got = llm.QUERIES["op12_importance_resampling"](spark, folder).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([tuple(r[:4]) for r in want], key=key)
    assert {r.doc_id: r["rank"] for r in got if r["rank"]} == drawn


def test_repeated_rows_are_each_ranked(spark):
    rows = spark.createDataFrame([(7, 30, 90, 5)] * 40 + [(8, 30, 90, 5)] * 40 + [(9, 3, 9, 10**9)], "doc_id long, n_words long, n_features long, weight long")
    got = importance.draw(rows, percent=50).filter("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 41))
    assert len({r.doc_id for r in got}) == 1 and 9 not in {r.doc_id for r in got}


def test_token_ends_do_not_depend_on_pieces():
    splitter = pre_tokenizers.Split(Regex(fill_in_middle.TOKEN), "isolated")
    for text in ["", " ", "a", " a  bc\t\nd ", "é  \U0001f600\r\n x" * 30, "x" * 200, " " * 200, "ab " * 50 + "  "]:
        want = [0, *[m.end() for m in re.finditer(fill_in_middle.TOKEN, text)]]
        for piece in (1, 3, 10, 1 << 20):
            assert fill_in_middle.token_ends(splitter, text, piece).tolist() == want


@pytest.mark.parametrize("folder", ["varied", SF])
def test_cut_texts_come_back(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "varied" else folder
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = llm.QUERIES["op13_fill_in_middle"](spark, folder).collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in got) == texts
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all((r.form == "plain") == (r.prefix_chars is None) == (r.output_sha256 == r.restored_sha256) for r in got)


def test_marked_texts_stay_plain_and_forms_are_drawn(spark):
    rows = [(i, t) for i, t in enumerate(["one <P> two", "<S>", "a<M>b c"] * 20 + ["one two  three\n"] * 400)]
    got = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.form == "plain" for r in got if r.doc_id < 60)
    forms = Counter(r.form for r in got if r.doc_id >= 60)
    assert 150 < forms["plain"] < 250 and forms["spm"] > 2 * forms["psm"] > 0
    for r in got:
        h = [int(hashlib.sha256(f"42:{r.doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        text = rows[r.doc_id][1]
        ends = [0, *[m.end() for m in re.finditer(fill_in_middle.TOKEN, text)]]
        assert r.n == len(ends) - 1
        if r.form != "plain":
            a, b = sorted((ends[h[0] % len(ends)], ends[h[1] % len(ends)]))
            assert (r.prefix_chars, r.middle_chars) == (a, b - a)
            assert r.output == (f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if r.form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")


def test_gains_in_doubles():
    target, source = np.array([0, 5, 2]), np.array([7, 0, 1])
    want = [math.floor(1000 * math.log((t + 1) * (8 + 3) / ((s + 1) * (7 + 3)))) for t, s in zip(target, source)]
    assert importance.gains(target, source).tolist() == want
