"""Each stage of the corpus pipeline against a plain version, on documents with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from framelake.llm import toxicity
from tests.llm.test_decontamination import _brute
from tests.llm.test_fixes import _components

ITEM = "A farmer has 12 sheep and 7 goats on the green hill near Dublin, and then does Maria sell 5 of them to the old man from the town?"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    dice = random.Random(21)
    word = lambda: "".join(dice.choices("abcdefghijkmnoprstuvwz", k=dice.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts: list[str | None] = [None, "", " \n"]
    labels = []
    for i in range(160):
        toxic = i % 4 == 0
        text = prose(40) + (f" you grumblesnark and {dice.choice(['v1lefink', 'vilefink', 'VILEFINK'])} " if toxic else " you and the old green hill from the town ") + prose(20)
        labels.append((len(texts), 1, int(toxic)))
        texts.append(text)
    base = [prose(60) for _ in range(12)]
    for text in base:
        texts += [text, text.upper(), text]
        words = text.split()
        for edits in (1, 2, 30):
            copy = list(words)
            for _ in range(edits):
                copy[dice.randrange(60)] = word()
            texts.append(" ".join(copy))
    texts += [f"{prose(30)}. {ITEM} {prose(10)}", f"{prose(5)}. {ITEM.replace('12', '1,200').replace('Maria', 'Anna Lou').replace('Dublin', 'New York')}", prose(20), ITEM[:40] + prose(30)]
    texts += [f"{prose(2)} GRUMBLESNARK v1lef1nk {prose(3)}", " ".join([word()] * 300), prose(3000)]
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _plain_score(lexicon, text):
    """Weights of the entries outside exceptions, by trying every place."""
    folded = toxicity.fold(text)
    same = folded.replace("l", "i")
    spared = [(a, a + len(p) + 2) for p in lexicon.exceptions for a in range(len(same)) if same.startswith(f" {p} ".replace("l", "i"), a)]
    total = 0.0
    for a in range(len(same)):
        found = [(len(e), w) for e, w in lexicon.entries.items() if same.startswith(e.replace("l", "i"), a)]
        found = [(n, w) for n, w in found if w == max(x for _, x in found)]
        if found and not any(x <= a and a + found[0][0] <= y for x, y in spared):
            total += found[0][1]
    import math

    return lexicon.score(math.log1p(1000 * total / (len(folded.split()) + 20)) if total else 0.0)


def test_stages_equal_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    left = set(text)
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert lexicon.entries
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    sizes = [len(left)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, tables)
        assert found.columns == docs.columns
        if name == "toxicity":
            want = {i for i in left if _plain_score(lexicon, text[i]) < toxicity.THRESHOLD}
        elif name == "exact_dedup":
            best: dict[str, int] = {}
            for i in sorted(left):
                best["".join(c.lower() if "A" <= c <= "Z" else c for c in text[i])] = i
            want = set(best.values())
        elif name == "ngram_jaccard_join":
            ids = sorted(left)
            want = {ids[k] for k, c in enumerate(_components([text[i] for i in ids], 5, 80)) if k == c}
        else:
            want = {i for i in left if not _brute(text[i], ITEM)}
        kept = [r.doc_id for r in found.collect()]
        assert sorted(kept) == sorted(want), name
        left = want
        sizes.append(len(left))
        path = f"{tables}/{name}"
        found.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {p.doc_id for p in pieces} == left
    run = corpus_pipeline.run(spark, tables)
    assert {p.doc_id for p in run.collect()} == left


def test_columns_with_internal_names_are_kept(spark):
    names = ["doc_id", "text", "__row", "__in", "__text", "kept_0", "count"]
    rows = [(i, t, f"r{i}", i, "x", "y", i) for i, t in enumerate(["same text of a few words", "Same text of a few words", None, ITEM, f"one more word and {ITEM}"])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, ("long", "string", "string", "int", "string", "string", "int"))))
    from framelake.llm import decontamination, exact_dedup, ngram_join

    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for stage, want in ((exact_dedup.keep_one, {1, 2, 3, 4}), (ngram_join.keep_first, {0, 2, 3}), (lambda d: decontamination.remove_leaks(d, items), {0, 1, 2})):
        found = stage(docs)
        assert found.columns == names
        kept = {tuple(r) for r in found.collect()}
        assert kept == {r for r in rows if r[0] in want}
