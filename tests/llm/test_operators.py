"""The training-data operators against brute force, on the smallest tables and on a fixture of odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from framelake.llm import queries as llm
from framelake.llm.suffix_groups import suffix_array

SF = "/root/testdata/sf0.001"
COLUMNS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("row", pa.string()), ("count", pa.int64())])
LONG = " ".join(f"word{i * i % 9973}" for i in range(30_000))
SHARED = "one passage of more than a hundred bytes that several of these documents hold word for word, with nothing changed at all in it"


def _folder(tmp_path_factory, texts):
    """Tables with extra columns whose names clash with internal ones."""
    folder = tmp_path_factory.mktemp("tables")
    ids = [None if i == 3 else i for i in range(len(texts))]
    rows = [{"doc_id": d, "text": t, "lang": None, "source": "s", "n_chars": None, "row": "x", "count": 1} for d, t in zip(ids, texts)]
    pq.write_table(pa.Table.from_pylist(rows, COLUMNS), folder / "documents.parquet")
    labels = [{"doc_id": i, "quality": i % 2, "toxic": 0} for i in range(0, len(texts), 2)] + ([{"doc_id": None, "quality": None, "toxic": None}] if texts else [])
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    items = [{"item_id": 1, "text": "What is 12 plus 30 in metres?"}, {"item_id": None, "text": None}] if texts else []
    pq.write_table(pa.Table.from_pylist(items, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    plain = [f"{SHARED} and then the number {i} of some words {i * 7} that differ" for i in range(6)]
    texts = [None, "", "  \t\n", "same text", "Same Text", "same text", "é \U0001f600 token=abcdef123", "a", LONG, LONG + " more", *plain, plain[0]]
    return _folder(tmp_path_factory, texts)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return _folder(tmp_path_factory, [])


def _texts(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def _run(spark, name, folder):
    return llm.QUERIES[name](spark, folder).collect()


def _key(doc_id):
    return (doc_id is not None, doc_id or 0)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert _run(spark, name, empty) == []


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert corpus_pipeline.run(spark, odd).count() > 0


@pytest.fixture(params=["odd", SF])
def folder(request):
    return request.getfixturevalue("odd") if request.param == "odd" else request.param


def test_packing_is_exact_and_tight(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = _run(spark, "op1_packing", folder)
    want = {}
    for doc_id, text in _texts(spark, folder):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.setdefault(doc_id, []).append(ids)
    for doc_id, copies in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        assert sum(x[1] for x in pieces) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, length, crc in pieces:
                assert start == at and crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in copies[0][start : start + length]))
                at += length
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(windows) <= total / 2048 * 1.05 + 1


def test_sharding_is_whole_and_even(spark, folder):
    rows = _run(spark, "op2_sharding", folder)
    want = sorted((_key(d), len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in _texts(spark, folder))
    assert sorted((_key(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    loads = {}
    for r in rows:
        loads.setdefault(r.shard, []).append(r)
    assert set(loads) <= set(range(24))
    for part in loads.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    bytes_of = [sum(r.size for r in loads.get(s, [])) for s in range(24)]
    assert max(bytes_of) <= sum(bytes_of) / 24 + max(r.size for r in rows)


def test_secret_base_spans(spark, folder):
    kinds = [
        ("assign", re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    rows = {}
    for r in _run(spark, "op3_secret_scan", folder):
        rows.setdefault(r.doc_id, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
    want = {}
    for doc_id, text in _texts(spark, folder):
        spans = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m.group(g)) >= n]
        digest = hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans)).encode()).hexdigest()
        want.setdefault(doc_id, []).append((*(sum(s[1] == k for s in spans) for k in range(3)), digest))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}


def test_exact_dedup_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({llm.SQL['op5_exact_dedup']})").fetchall()
    found = llm.QUERIES["op5_exact_dedup"](spark, folder).select(names).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_suffix_dedup_equals_brute_force(spark, folder):
    docs = [(d, t.encode()) for d, t in sorted(_texts(spark, folder), key=lambda x: _key(x[0]))]
    seen, want = set(), []
    for doc_id, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            string = raw[i : i + 100]
            if string in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(string)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want.append((_key(doc_id), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    rows = _run(spark, "op6_suffix_array_dedup", folder)
    assert sorted((_key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(want)


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"mississippi\xff", b"abab" * 9, bytes(range(256)) * 2])
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_ngram_join_equals_brute_force(spark, folder):
    docs, sets = _texts(spark, folder), []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set())
    part = list(range(len(docs)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    want = sorted((_key(d), len(sets[i]), _key(least.get(find(i)))) for i, (d, _) in enumerate(docs))
    assert sorted((_key(r.doc_id), r.n_shingles, _key(r.component_id)) for r in _run(spark, "op7_ngram_jaccard_join", folder)) == want


@pytest.mark.parametrize(("name", "cut"), [("op9_quality_classifier", 0.3), ("op10_toxicity", 0.5)])
def test_classifiers_answer_for_every_row(spark, name, cut):
    rows = _run(spark, name, "/root/testdata/sf0.01")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("name", ["op8_pii", "op9_quality_classifier", "op10_toxicity"])
def test_odd_rows_keep_their_number(spark, odd, name):
    assert len(_run(spark, name, odd)) == len(_texts(spark, odd))


def test_pipeline_keeps_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        kept = {r.doc_id for r in left.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(kept) > 100, name
