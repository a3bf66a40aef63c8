"""Benchmark decontamination on planted copies."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from framelake.llm import decontamination

ACCENTED = "el niño pequeño comió después una piña y también un plátano verde en la estación del río según su abuela"
GERMAN = "die straße führt über den großen fluß und weiter durch das schöne grüne tal bis zur alten mühle"


@pytest.fixture
def leaks(spark):
    def run(docs, items):
        docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        return {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, items).collect()}

    return run


def test_accented_copies_in_capitals_are_leaks(leaks):
    items = [ACCENTED, GERMAN]
    found = leaks([f"Vorher {x.upper()} nachher" for x in items] + ["nothing of the kind stands in here at all, not one passage"], items)
    assert set(found) == {(0, 0), (1, 1)}


def test_folding_keeps_word_boundaries():
    texts = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    low, ends = decontamination.folded(data, offsets)
    inside = decontamination._word_bytes > 0
    assert (np.minimum.reduceat(inside[low], ends[:-1]) == np.minimum.reduceat(inside[data], offsets[:-1])).all()
    assert (np.maximum.reduceat(inside[low], ends[:-1]) == np.maximum.reduceat(inside[data], offsets[:-1])).all()


def test_bytes_that_are_no_text_are_kept():
    raw = b"ab\xff\xfe CD \xc3\x89"
    low, _ = decontamination.folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert low.tobytes() == b"ab\xff\xfe cd \xc3\xa9"


PLAIN = "How many of the baskets does Maria fill. In Paris she sells 12 pears and keeps 7 apples; the rest goes to Peter in the old barn"


def test_copies_are_leaks_whatever_looks_like_a_name(leaks):
    items = [PLAIN, "Capital of the country beside the great river"]
    bare = re.sub(r"[.;]", "", PLAIN)
    docs = [bare, f"and so on\n{PLAIN.title()}", PLAIN.upper(), f"we ask for the {items[1]} again", "Capital of one other land by some small brook"]
    assert set(leaks(docs, items)) == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_windows_without_evidence_are_not_counted(leaks):
    names = "we saw " + " ".join(f"Ann Bob Carl Dora Emil and Fritz {i}" for i in range(3)) + " before the long walk to the old mill with 15 friends"
    other = re.sub(r"\bAnn\b", "Gert", names).replace("15", "26").replace("Bob", "Hans").replace("Carl", "Ida").replace("Dora", "Jan").replace("Emil", "Karl").replace("Fritz", "Lore")
    found = leaks([names, other], [names])
    assert found[0, 0].matched_windows == found[0, 0].item_windows == len(names.split()) - 7
    assert found[1, 0].matched_windows == found[1, 0].item_windows < len(names.split()) - 7


SUM = "Bob has 3 apples and 5 pears in the blue basket, so how many pieces of fruit does he hold at last?"
TWICE = "a small train leaves the town at 12 and reaches the hills by noon, then it turns back on the very same line, and with 12 guests on board it comes home late"


def test_values_that_coincide_and_one_edited_number(leaks):
    docs = [SUM.replace("3", "4").replace("5", "4"), TWICE[::-1].replace("21", "51", 1)[::-1], "We pick 3 apples and 3 pears. " + TWICE[:20]]
    found = leaks(docs, [SUM, TWICE])
    assert set(found) == {(0, 0), (1, 1)}
    items = ["Take 3 apples and 5 pears home", "at 12 the bell of the town rings, at 12 the bell of the hill rings, and at 12 all go"]
    docs = ["Take 4 apples and 4 pears home", items[1].replace("12", "40").replace("40", "41", 1), "Take 3 apples and 3 plums home"]
    assert set(leaks(docs, items)) == {(0, 0), (1, 1)}
    assert found[0, 0].changed_slots == 2 and found[1, 1].matched_windows < found[1, 1].item_windows


def test_names_and_numbers_of_other_lengths(leaks):
    item = "On a trip to the coast in Paris the guide sells 4 maps and then does Maria carry 1500 small boxes to the far end of the pier"
    docs = [item.replace("Paris", a).replace("Maria", b).replace("1500", c) for a, b, c in (("Rome", "Peter", "1,500"), ("New York", "Jean Paul", "4.5"), ("San Jose del Cabo", "Eva", "2,300,000"))]
    assert set(leaks([*docs, "On a trip by the coast of Paris no guide sells maps, nor does Maria carry boxes"], [item])) == {(0, 0), (1, 0), (2, 0)}


def test_items_of_numbers_and_names(leaks):
    item = "So Ann 12, Bob 13, Carl 14, Dora 15 and Emil 16 then Fritz 17, Gert 18, Hans 19 in total of"
    docs = [item.replace("12", "21").replace("Ann", "Zoe Lou").replace("Hans", "Ida"), item.replace("Fritz", "17"), "So Ann 12, Bob 13, Carl 14"]
    assert (0, 0) in leaks(docs, [item]) and (2, 0) not in leaks(docs, [item])


NAMED = "At the shop of Jürgen we buy 5kg of flour and the man from IBM pays 15 euros for all of it"


def test_names_of_all_alphabets_and_units_without_a_blank(leaks):
    other = NAMED.replace("Jürgen", "{}").replace("5kg", "{}").replace("IBM", "{}").replace("15 euros", "{}")
    docs = [other.format(*x) for x in (("Élodie", "7kg", "NASA", "3 euros"), ("Иван", "12 kg", "Łukasz", "4 euros"), ("Maria", "1.5kg", "Özil", "99 euros"))]
    docs += [NAMED.upper(), NAMED.upper().replace("15", "16"), "At the shop of Jürgen we buy plums"]
    assert {d for d, _ in leaks(docs, [NAMED])} == {0, 1, 2, 3, 4}


def _words(text):
    """(folded word, kind, whether it goes on with the token before) of a text."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+|[A-Za-z\x80-\U0010ffff]+", text)]
    words = [text[a:b] for a, b in spans]
    gaps = [None] + [text[a[1] : b[0]] for a, b in zip(spans, spans[1:])]
    follows = [g is not None and not re.search(r"[\n\r!.:;?]", g) for g in gaps]
    loud = [len(w) > 1 and w[0].isupper() and w[1].isupper() for w in words]
    alone = [x and not any(loud[max(k - 1, 0) : k] + loud[k + 1 : k + 2]) for k, x in enumerate(loud)]
    cap = [len(w) > 1 and w[0].isupper() and w[1].islower() or a for w, a in zip(words, alone)]
    digits = [bool(re.fullmatch("[0-9]+", w)) for w in words]
    kinds = []
    for k, word in enumerate(words):
        opens = cap[k] and not follows[k] and k + 1 < len(words) and follows[k + 1] and cap[k + 1] and gaps[k + 1] == " "
        unit = follows[k] and digits[k - 1] and word.casefold() in decontamination.UNITS
        kinds.append("n" if digits[k] else "u" if unit else "N" if cap[k] and follows[k] or opens else "")
    out = []
    for k, word in enumerate(words):
        more = k > 0 and (kinds[k] == kinds[k - 1] == "N" and gaps[k] == " " or digits[k] and digits[k - 1] and gaps[k] in (",", "."))
        out.append((word.casefold(), kinds[k], more))
    return out


def _tokens(words):
    out = []
    for word, kind, more in words:
        if more:
            out[-1] = (out[-1][0] + (word,), kind)
        else:
            out.append(((word,), kind))
    return out


def _brute(text, item, window=8, literals=4, coverage=0.5, run=6):
    doc, item = _words(text), _words(item)
    a, b = [w for w, _, _ in item], [w for w, _, _ in doc]
    size = min(window, len(a))
    places = range(len(a) - size + 1)
    for shift in range(-len(a), len(b)):
        n = sum(p + shift >= 0 and a[p : p + size] == b[p + shift : p + shift + size] for p in places)
        if n and (n >= len(places) * coverage or n >= run):
            return True
    a, b = _tokens(item), _tokens(doc)
    size = min(window, len(a))
    places = range(len(a) - size + 1)
    can = [p for p in places if sum(not k for _, k in a[p : p + size]) >= min(literals, size)]
    strict = not can and sum(not k for _, k in a) >= literals
    can = list(places) if strict else can
    for shift in range(-len(a), len(b)):
        pairs = {}
        for p in can:
            here, there = a[p : p + size], b[max(p + shift, 0) : p + shift + size]
            if p + shift >= 0 and [k or w for w, k in here] == [k or w for w, k in there]:
                pairs[p] = {(x, y) for (x, k), (y, _) in zip(here, there) if k}
        stands = {}
        for value in {x for pair in pairs.values() for x, _ in pair}:
            votes = [y for pair in pairs.values() for x, y in pair if x == value]
            stands[value] = max(set(votes), key=lambda y: (votes.count(y), y == value))
        n = sum(all(x == y for x, y in pair) or all(stands[x] == y for x, y in pair) for pair in pairs.values())
        if n and (n >= len(can) if strict else n >= len(can) * coverage or n >= run):
            return True
    return False


def test_leaks_equal_brute_force(leaks):
    rng = random.Random(5)
    items = [SUM, TWICE, PLAIN, ACCENTED, "Capital of the country beside the great river", "Where is 12 Acre Wood?", "one 2 three", "Take 3 apples and 5 pears home", NAMED]
    docs = []
    for _ in range(60):
        text = rng.choice(items)
        words = text.split()
        a = rng.randrange(len(words))
        part = " ".join(words[a : a + rng.randrange(5, 40)]) if rng.random() < 0.5 else text
        for _ in range(rng.randrange(4)):
            old = rng.choice(["3", "5", "12", "Bob", "7", "Peter", "apples", "guests", "then", "niño", "Jürgen", "IBM", "5kg"])
            part = part.replace(old, rng.choice(["4", "4", "12", "1,250", "Hans", "Anna Maria", "plums", "Maria", "Élodie", "Иван", "NASA", "9kg"]), rng.choice([1, -1]))
        docs.append("Before it " + rng.choice([str, str.upper, str.title, str])(part) + rng.choice([". After it.", " and on 2"]))
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if _brute(text, item)}
    assert set(leaks(docs, items)) == want
    assert 20 < len(want) < len(docs) * 2
