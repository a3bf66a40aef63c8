"""Token ids and best fit against plain versions."""

from __future__ import annotations

import random

import numpy as np

from framelake.llm import packing

#: Letters of many scripts, marks, contractions, blanks of all kinds, and code points that only newer tables assign.
ALPHABET = [*"aZ'sdtm 09\n\t.,é", "ß", "й", "中", "あ", "　", "\xa0", "́", "١", "Ⅷ", "😀", "²", "\U000134e2", "\U0001c8a0", "Ᲊ", "\U00010d4a", "⿿", "\U0002ebf0", "\U000e0100"]

#: A word and its complement that every polynomial hash modulo 2**64 takes for one.
THUE_MORSE = "".join("ab"[k.bit_count() & 1] for k in range(4096))
SWAPPED = str.maketrans("ab", "ba")


def test_ids_equal_the_tokenizer():
    dice, coder = random.Random(5), packing.BatchTokenizer()
    texts = ["".join(dice.choices(ALPHABET, k=dice.randint(0, 40))) for _ in range(4000)]
    texts += [THUE_MORSE, THUE_MORSE.translate(SWAPPED), f"{THUE_MORSE} {THUE_MORSE.translate(SWAPPED)}"]
    texts += ["x" * 3000, "it's we'll I'm they've 're 'S", *coder.special, f"a {coder.special[0]} b" if coder.special else ""]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, ids in zip(some, coder.encode(some), strict=True):
            assert ids.tolist() == coder.own.encode(text, add_special_tokens=False).ids, repr(text)


def test_units_are_forgotten_and_learned_again():
    coder = packing.BatchTokenizer(remembered=20)
    texts = [" ".join(f"word{i * j}" for j in range(30)) for i in range(40)]
    for _ in range(2):
        for text in texts:
            assert coder.encode([text])[0].tolist() == coder.own.encode(text, add_special_tokens=False).ids


def test_best_fit_equals_a_loop():
    dice = random.Random(3)
    for _ in range(100):
        lengths = [dice.randint(1, 60) for _ in range(dice.randint(0, 80))]
        rooms: list[int] = []
        for need in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= need]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - need)
            else:
                rooms.append(64 - need)
        where, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
        assert len(set(where.tolist())) == len(rooms)
        used = sorted(64 - sum(n for n, w in zip(lengths, where) if w == k) for k in set(where.tolist()))
        assert used == sorted(rooms)
        for k in set(where.tolist()):
            at = 0
            for o, n in sorted((o, n) for o, n, w in zip(offset.tolist(), lengths, where.tolist()) if w == k):
                assert o == at
                at += n
