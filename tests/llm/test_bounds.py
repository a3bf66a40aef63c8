"""Hash collisions of a known pattern, texts dense with matches, and blocks of bounded size."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa

from framelake.llm import ngram_join, pii, quality, secrets, toxicity

from .test_packing import SWAPPED, THUE_MORSE


def test_unlike_words_of_equal_polynomials_are_not_linked(spark):
    rows = [(1, f"{THUE_MORSE} q r"), (2, f"{THUE_MORSE.translate(SWAPPED)} q r"), (3, f"{THUE_MORSE} q r")]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1}


def test_regions_move_once_and_are_told_across_batches(spark, monkeypatch):
    """Nothing is kept for each region of one member; a region's rows may lie in several batches."""
    plans, store = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), store(df, label))[1])
    dice = random.Random(3)
    rows = [(k, 5, bytes([k % 90, k // 90]), sorted({7, *(dice.randrange(400) for _ in range(6))} - ({7} if k % 3 else set()))) for k in range(120)]
    sets = store(spark.createDataFrame(rows, "__row long, n_shingles long, set_key binary, regions array<long>"), "sets")
    where = {}
    for row, _, _, regions in rows:
        for region in regions:
            where.setdefault(region, []).append(row)
    want = sorted((region, row, min(rows)) for region, rows in where.items() if len(rows) > 1 for row in rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for most, size in ((1 << 20, "1"), (50, "3"), (50, "10000")):
        monkeypatch.setattr(ngram_join, "PART_ROWS", most)
        spark.conf.set(name, size)
        assert sorted(map(tuple, ngram_join.shared_regions(sets).collect())) == want
    spark.conf.unset(name)
    assert sum("Generate explode(regions" in plan for plan in plans) == 3 and not any("Aggregate [region" in plan for plan in plans)


def test_a_comparison_holds_one_region_and_a_range_of_its_ngrams(spark, monkeypatch):
    dice = np.random.default_rng(2)
    pool = np.unique(dice.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
    sets = [np.sort(dice.choice(pool, size, replace=False)) for size in dice.integers(1, 120, 40)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for at_once in (1, 90, 1 << 20):
        found = ngram_join.intersections(sets, 16, at_once)
        assert all(found[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j)
    rows = [(k % 7, k, s.tobytes()) for k, s in enumerate(sets)] + [(k % 7, 100 + k, s.tobytes()) for k, s in enumerate(sets)]
    monkeypatch.setattr(ngram_join, "REGION_GRAMS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    links = ngram_join._block_links(spark.createDataFrame(rows, "region long, member long, shingles binary"), 90)
    assert "FlatMapGroups" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert {(k, 100 + k) for k in range(40)} <= {tuple(sorted(r)) for r in links.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grouped_account_numbers_are_permuted_in_their_groups(spark):
    values = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "AT61 1904 3002 3457 3201", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    texts = [f"pay to {v} IN MAY, or {v}." for v in values] + ["DE88 3704 0044 0532 0130 00 fails"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "key").collect()}
    for k, value in enumerate(values):
        first, second = rows[k].text[len("pay to ") : -1].split(" IN MAY, or ")
        assert rows[k].n_iban == 2 and first == second != value
        assert [c.isdigit() if c.isalnum() else c for c in first] == [c.isdigit() if c.isalnum() else c for c in value]
        plain = first.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert rows[0].text.split(" IN ")[0].replace(" ", "") == rows[1].text.split(" IN ")[0].replace(" ", "")
    assert rows[len(values)].text == texts[-1] and rows[len(values)].n_iban == 0


def test_hits_outside_exceptions_equal_a_plain_search():
    dice = random.Random(4)
    lexicon = toxicity.Lexicon({" bad ": 2.0, " evil": 3.0, " worse ": 1.0}, ["bad luck", "too bad", "evil eye"])
    for _ in range(50):
        text = toxicity.fold(" ".join(dice.choices(["bad", "luck", "too", "evil", "eye", "evils", "worse", "x"], k=60)))
        spared = [(i, i + len(p) + 2) for p in lexicon.exceptions for i in range(len(text)) if text.startswith(f" {p} ", i)]
        want = {}
        for entry, weight in lexicon.entries.items():
            for i in range(len(text)):
                if text.startswith(entry, i) and weight > want.get(i, (0, 0))[1]:
                    want[i] = (i + len(entry), weight)
        want = {(a, b, w) for a, (b, w) in want.items() if not any(x <= a and b <= y for x, y in spared)}
        assert set(lexicon.hits(text)) == want


def test_dense_exceptions_take_time_in_proportion():
    lexicon = toxicity.Lexicon({" bad ": 2.0}, ["bad luck"])
    seconds = []
    for n in (2000, 16000):
        text = toxicity.fold("bad luck " * n)
        lexicon.hits(text)
        began = time.process_time()
        assert lexicon.hits(text) == []
        seconds.append(time.process_time() - began)
    assert seconds[1] < 30 * seconds[0] + 0.05


def test_code_points_and_overlaps_equal_plain_ones():
    dice = random.Random(6)
    text = "".join(dice.choices(["a", "é", "中", "😀", " "], k=300))
    points = secrets._points(text.encode())
    for k in range(len(text) + 1):
        assert points[len(text[:k].encode())] == k
    for _ in range(50):
        base = [("k", a := dice.randrange(90), a + dice.randint(1, 9)) for _ in range(8)]
        spans = [(a := dice.randrange(95), a + dice.randint(1, 5)) for _ in range(20)]
        assert secrets._apart(spans, base) == [(x, y) for x, y in spans if all(y <= s[1] or s[2] <= x for s in base)]


def test_weights_are_held_for_few_rows_at_a_time():
    texts = pa.array([f"text {i}" for i in range(1000)])
    blocks = list(quality.term_weights(texts, np.ones(quality.WORD_BINS, np.float32)))
    assert max(map(len, blocks)) <= quality.BLOCK_ROWS and sum(map(len, blocks)) == 1000


def _feistel(values, radices, tag, key):
    """The permutation of several numbers, written out."""
    half = len(values) // 2
    a, b = values[:half], values[half:]
    draw = lambda k, i, other: int(hashlib.sha256("|".join([key, tag, str(k), str(i), ",".join(map(str, other))]).encode()).hexdigest()[:8], 16)
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            a = [(x + draw(k, i, b)) % radices[i] for i, x in enumerate(a)]
        else:
            b = [(x + draw(k, i, a)) % radices[half + i] for i, x in enumerate(b)]
    return a + b


def test_numbers_equal_a_plain_permutation(spark):
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in ((123, 45, 6789), (665, 1, 1), (667, 99, 9999), (899, 50, 12))]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in pii.pseudonymise(docs, "secret").collect()}
    for k, value in enumerate(values):
        area, group, serial = map(int, value.split("-"))
        x, y, z = _feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], "ssn", "secret")
        assert found[k] == f"{x + (2 if x >= 665 else 1):03d}-{y + 1:02d}-{z + 1:04d}"
    hosts = ["10.0.0.1", "192.168.17.254", "255.255.255.255"]
    docs = spark.createDataFrame(list(enumerate(hosts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in pii.pseudonymise(docs, "secret").collect()}
    for k, host in enumerate(hosts):
        assert found[k] == ".".join(map(str, _feistel([int(x) for x in host.split(".")], [256] * 4, "ip", "secret")))


def test_votes_equal_a_plain_search():
    dice = np.random.default_rng(3)
    labelled = np.abs(dice.standard_normal((60, quality.TERMS))).astype(np.float32) * (dice.random((60, quality.TERMS)) < 0.02)
    labelled[10] = labelled[11] = labelled[12]  # equally near ones
    labels = dice.integers(0, 2, 60)
    model = quality.LatentNeighbours(labelled.astype(np.float32), labels, np.ones(quality.WORD_BINS, np.float32), 8)
    asked = np.concatenate([labelled[:20] + 0.01, np.zeros((1, quality.TERMS))]).astype(np.float32)
    found = model.vote(asked, block=4)
    for row, score in zip(asked, found):
        at = row.astype(np.float32) @ model.axes
        at = at / max(np.linalg.norm(at), 1e-12)
        cosine = [float(np.float32(at @ v)) for v in model.vectors]
        order = sorted(range(60), key=lambda i: (-cosine[i], i))[: quality.VOTES]
        weight = [max(cosine[i], 0) ** quality.SHARPNESS for i in order]
        want = sum(w * labels[i] for w, i in zip(weight, order)) / sum(weight) if sum(weight) > 0 else labels.mean()
        assert abs(score - want) < 1e-3
