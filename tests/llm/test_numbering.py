"""Row numbers do not depend on how a scan splits its files."""

from __future__ import annotations

import pytest

from framelake.llm import decontamination, exact_dedup, ngram_join
from framelake.storage import numbered

SF = "/root/testdata/sf0.001"
SPLIT = "spark.sql.files.minPartitionNum"


@pytest.fixture
def split(spark):
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.unset(SPLIT)


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12, "doc_id").write.parquet(path)
    return lambda: spark.read.parquet(path)


def test_numbers_agree_between_scans(split, docs):
    found = []
    for n in (1, 24):
        split(n)
        table = docs()
        found.append((table.rdd.getNumPartitions(), {(r.doc_id, r["__row"]) for r in numbered(table).select("doc_id", "__row").collect()}))
    assert found[0][0] != found[1][0]
    assert found[0][1] == found[1][1] and len({row for _, row in found[0][1]}) == docs().count()


@pytest.mark.parametrize("module", [exact_dedup, ngram_join, decontamination])
def test_the_same_rows_stay_when_splits_change_in_between(spark, split, docs, module, monkeypatch):
    inner = {exact_dedup: "decide", ngram_join: "groups", decontamination: "leaks"}[module]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    stage = {exact_dedup: exact_dedup.keep_one, ngram_join: ngram_join.keep_first, decontamination: lambda d: decontamination.remove_leaks(d, benchmark)}[module]
    want = sorted(r.doc_id for r in stage(docs()).select("doc_id").collect())
    plain = getattr(module, inner)

    def resplit(table, *args):
        split(1)
        out = plain(table, *args)
        out = spark.createDataFrame(out.collect(), out.schema)
        split(24)
        return out

    monkeypatch.setattr(module, inner, resplit)
    assert sorted(r.doc_id for r in stage(docs()).select("doc_id").collect()) == want


def test_tables_that_are_not_stored_are_numbered_too(docs):
    table = docs()
    union = table.union(table)
    left = exact_dedup.keep_one(union)
    assert left.columns == table.columns
    assert left.count() == exact_dedup.keep_one(table).count()
