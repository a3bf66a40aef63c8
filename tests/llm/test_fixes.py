"""Field decoding, pseudonyms, folding, slot maps and classifiers against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from framelake.llm import pii, queries, secrets, sharding, toxicity

SF = "/root/testdata/sf0.01"


def _plain_viterbi(field, ids, document):
    """Best states of each document, by all steps at once; no pruning, no cost at the end."""
    out = []
    e, step = field._emissions(ids), field._steps()
    for d in sorted(set(document.tolist())):
        at = np.flatnonzero(document == d)
        best = e[at[0]] + [0, 0, field.NEVER]
        back = []
        for i in at[1:]:
            through = best[:, None] + step
            back.append(through.argmax(0))
            best = through.max(0) + e[i]
        state = int(best.argmax())
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        spans: list[list[int]] = []
        for i, s in zip(at.tolist(), reversed(states)):
            if s == 1:
                spans.append([i, i])
            elif s == 2 and spans:
                spans[-1][1] = i
        out += [tuple(x) for x in spans]
    return out


def test_decoding_equals_plain_viterbi():
    dice = np.random.default_rng(11)
    for turn in range(200):
        field = secrets.Field()
        field.token = dice.normal(-0.4, 1.0, field.token.shape)
        field.step = dice.normal(0, 1.0, (3, 3))
        field.fitted = True
        n = int(dice.integers(1, 40))
        ids = dice.integers(0, len(field.token), (n, len(secrets.WIDTHS))).astype(np.int32)
        document = np.sort(dice.integers(0, 4, n))
        assert field.decode(ids, document) == _plain_viterbi(field, ids, document), turn


def test_field_finds_a_secret_at_the_end_of_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = secrets.fit(docs)
    other = secrets.fit(docs.repartition(7))
    assert np.array_equal(field.token, other.token)
    rows = spark.createDataFrame([(1, "the report is due. credential: Zk83hQw9LmX2vT7bRc4NpYs6"), (2, "nothing here but words of a plain sentence"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scan(rows, field).collect()}
    assert found[2] == [] and found[3] == []
    assert [(s.kind, s.end) for s in found[1]] == [("crf", 31 + 24)]


def _pseudonyms(spark, values, key="k"):
    rows = spark.createDataFrame([(i, f"<{v}>") for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text[1:-1] for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_link(spark):
    values = ["+49 30 1234", "+49 30 5678", "+1 555 123 4567", "(555) 123-4567", "a@example.org", "b@example.org", "Ab.c9@example.org", "10.1.2.3", "2024-02-29", "123-45-6789", "4111 1111 1111 1111"]
    new = _pseudonyms(spark, values)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    for old, other in zip(values, new):
        if "@" in old:
            assert other.endswith("@example.org") and shape(other) == shape(old)
        elif not old.startswith("10."):
            assert shape(other) == shape(old)
    assert new[0].startswith("+49 ") and new[1].startswith("+49 ") and new[2].startswith("+1 ")
    assert new[0] != values[0] and new[0] != new[1]
    digits = lambda s: re.sub("[^0-9]", "", s)[-10:]
    assert digits(new[2]) == digits(new[3])
    assert _pseudonyms(spark, values) == new
    assert _pseudonyms(spark, values, "other") != new
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "")


def test_pseudonyms_of_a_format_are_a_permutation(spark):
    letters = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(_pseudonyms(spark, letters)) == letters
    numbers = [f"123-45-{n:04d}" for n in range(1, 400)]
    new = _pseudonyms(spark, numbers)
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", x) for x in new)


def _luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_card_and_account_checks_hold(spark):
    dice = random.Random(2)
    cards = []
    while len(cards) < 60:
        body = "4" + "".join(dice.choices("0123456789", k=15))
        if _luhn(body):
            cards.append(body)
    assert all(_luhn(x) and len(x) == 16 for x in _pseudonyms(spark, cards))
    iban = _pseudonyms(spark, ["DE89370400440532013000"])[0]
    moved = iban[4:] + iban[:4]
    assert iban[:2] == "DE" and iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    # a failing check digit is no card, and stays
    assert _pseudonyms(spark, ["4111111111111112"]) == ["4111111111111112"]


def test_found_values_equal_a_plain_search(spark):
    """Counts of the kinds that have no check, over whole texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_email, r.n_ssn) for r in queries.QUERIES["op8_pii"](spark, SF).collect()}
    mail = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,8}")
    number = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
    assert found == {r.doc_id: (len(mail.findall(r.text or "")), len(number.findall(r.text or ""))) for r in rows}
    assert sum(a for a, _ in found.values()) > 0


def test_every_spelling_of_an_entry_is_found():
    lexicon = toxicity.Lexicon({" lullabill": 3.0})
    for letters in itertools.product("l1i", repeat=5):
        word = "{}u{}{}abi{}{}".format(*letters)
        if word.startswith("1") or not word[0].isalpha():
            continue
        assert lexicon.hits(toxicity.fold(f"a {word} b")), word
    assert not lexicon.hits(toxicity.fold("a different word"))


def test_slot_maps_are_loaded_edited_and_numbered(spark, tmp_path):
    maps = sharding.SlotMaps(spark, f"file://{tmp_path}/maps")
    assert maps.versions() == []
    with pytest.raises(ValueError):
        maps.load()
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text")
    first = {r.doc_id: r.shard for r in sharding.shard_documents(docs, maps).collect()}
    assert maps.versions() == [0, 1]
    again = {r.doc_id: r.shard for r in sharding.shard_documents(docs, maps).collect()}
    assert maps.versions() == [0, 1, 2, 3] and again == first
    cell = maps.load().first().cell
    edited = maps.edit(spark.createDataFrame([(cell, 23)], "cell int, shard int"))
    assert maps.versions()[-1] == 4 and edited.filter(f"cell = {cell}").first().shard == 23
    assert edited.count() == maps.load(0).count()
    more = docs.union(spark.range(3000, 3300).selectExpr("id AS doc_id", "repeat('y', 20) AS text"))
    later = {r.doc_id: r.shard for r in sharding.shard_documents(more, maps).collect()}
    moved = sum(later[k] != v for k, v in first.items())
    assert moved < 600


@pytest.mark.parametrize(("name", "label", "rare"), [("op9_quality_classifier", "quality", 0), ("op10_toxicity", "toxic", 1)])
def test_rare_class_is_found(spark, name, label, rare):
    """Recall and precision of the rarer label on held-out rows; answering the commoner one always gives 0."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in truth]
    wanted = {r.doc_id for r in rows if truth[r.doc_id] == rare}
    given = {r.doc_id for r in rows if r.predicted == rare}
    assert len(wanted) >= 20
    assert len(wanted & given) / len(wanted) >= 0.9
    assert len(wanted & given) / len(given) >= 0.9


def _components(texts, words, percent):
    sets = []
    for text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets.append({tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set())
    part = list(range(len(texts)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 70, 3), (1, 60, 4)])
def test_ngram_join_in_crowded_regions(spark, monkeypatch, words, percent, seed):
    """Families of copies with edits, common passages and short texts; regions so small that splits, windows, regions and chunks all take part."""
    from framelake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "REGION_ROWS", 6)
    monkeypatch.setattr(ngram_join, "ROUNDS", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    monkeypatch.setattr(ngram_join, "COMMON", 8)
    dice = random.Random(seed)
    word = lambda: f"w{int(dice.paretovariate(0.6)) % 300}"
    passage = [word() for _ in range(20)]
    texts = ["", " ", "one", "one two", "One two"]
    for family in range(14):
        base = [word() for _ in range(dice.choice([4, 9, 30, 60, 120]))]
        if family % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(dice.choice([1, 2, 9, 25])):
            copy = list(base)
            for _ in range(dice.choice([0, 1, 2, 4, 8])):
                copy[dice.randrange(len(copy))] = word()
            if dice.random() < 0.3:
                base = copy
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.groups(docs, words, percent).collect()}
    assert [found[i] for i in range(len(texts))] == _components(texts, words, percent)


def test_quality_tells_texts_apart_by_their_words(spark):
    """Both labels have the same marks, capitals and word lengths, in Latin and in Cyrillic; words alone differ."""
    from framelake.llm import quality

    dice = random.Random(8)
    good = ["river", "stone", "light", "water", "green", "house", "вода", "свет"]
    bad = ["cheap", "click", "prize", "bonus", "offer", "deals", "купи", "цена"]
    rows, labels = [], []
    for i in range(300):
        label = i % 2
        words = [dice.choice(good if label else bad) if dice.random() < 0.5 else dice.choice(["and", "with", "then", "там"]) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, label, 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1])], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(found) == 303 and found[900].score == found[901].score and found[902].score == found[0].score
    tested = [i for i in range(300) if found[i].held_out]
    assert len(tested) > 30 and sum((found[i].score >= 0.5) == (i % 2 == 1) for i in tested) >= 0.85 * len(tested)


def test_nearest_neighbours_and_ties():
    from framelake.llm.quality import LatentNeighbours

    dice = np.random.default_rng(4)
    for _ in range(50):
        cosine = np.round(dice.random((5, 30)), 1)
        want = np.sort(np.lexsort((np.broadcast_to(np.arange(30), cosine.shape), -cosine), axis=1)[:, :7], axis=1)
        assert np.array_equal(LatentNeighbours.nearest(cosine, 7), want)
