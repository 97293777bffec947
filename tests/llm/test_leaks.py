"""Benchmark leaks against a plain version."""

import random

import pytest

from barsmith.llm import templates
from tests.llm import brute

DOC = "doc_id long, text string"


def texts(seed):
    rnd = random.Random(seed)
    words = ["the", "sum", "of", "is", "found", "when", "train", "leaves", "Paris", "don't", "x-ray", "größe", "apples", "buys", "and"]
    slot = lambda: rnd.choice(["3", "4.5", "1/2", "17", "Anna", "Bob", "Zoltan", "5 km", "7 hours", "$", "12%"])
    sentence = lambda n: " ".join(rnd.choice(words) if rnd.random() < .8 else slot() for _ in range(n)) + rnd.choice([".", "?", "\n"])
    items = [(i, " ".join(sentence(rnd.randint(3, 14)) for _ in range(rnd.randint(1, 3)))) for i in range(25)]
    items += [(30, "12 + 30"), (31, "Größe found"), (32, "apples"), (33, None), (34, ""), (None, items[0][1]), (35, items[1][1]),
              (36, "3 4 5 6 7 8 9 10 11"), (37, "Second km")]

    def other_values(t):
        old = [w for w in t.split() if w[0].isdigit() or w in ("Anna", "Bob", "Zoltan")]
        new = {w: (str(rnd.randint(100, 999)) if w[0].isdigit() else rnd.choice(["Carlos", "Emma", "Kiara"])) for w in old if "%" not in w and "." not in w}
        return " ".join(new.get(w, w) for w in t.split())
    docs = [(i, sentence(rnd.randint(1, 60))) for i in range(40)]
    for i, (_, t) in enumerate(items[:25]):
        docs += [(100 + i, sentence(10) + " " + t + " " + sentence(10)), (200 + i, other_values(t)), (300 + i, t.upper()),
                 (400 + i, " ".join(t.split()[:len(t.split()) // 2]))]
    docs += [(500, None), (501, ""), (502, "12 + 30 + 12 + 30"), (503, "the 3 4 5 6 7 8 9 10 11"), (504, "Größe found apples"),
             (505, "x " * 300 + items[2][1]), (506, (items[3][1] + " ") * 6), (506, "other text"), (507, "second KM"), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed,slab", [(1, 1 << 20), (2, 64)])
def test_leaks_match_brute(spark, monkeypatch, seed, slab):
    docs, items = texts(seed)
    monkeypatch.setattr(templates, "SLAB", slab)
    templates.characters.cache_clear()
    d = spark.createDataFrame(docs, DOC).repartition(3)
    found = templates.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.matched, r.windows, r.reworded) for r in found.collect()}
    assert got == brute.leaks(docs, items, templates.NAMES, templates.UNITS)


@pytest.mark.parametrize("slab", [40, 1 << 20])
def test_scanned_tokens_are_the_pattern_s(monkeypatch, slab):
    monkeypatch.setattr(templates, "SLAB", slab)
    known = templates.Characters()
    rnd = random.Random(3)
    chars = "abcXYZéß'’-. ,:/0123٣²_!?\n%$€£😀𝔸 \t"
    all_ = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    for t in all_:
        h, kind, first = known.scan(t)
        tokens = list(brute.TOKEN.finditer(t))
        assert first.tolist() == [m.start() for m in tokens]
        names = {}
        for m, x in zip(tokens, h.tolist()):
            assert names.setdefault(x, m.group().lower()) == m.group().lower()
    x = templates.Templates([*all_, None, "a b"], known)
    for i, t in enumerate([*all_, None, "a b"]):
        assert x.start[i + 1] - x.start[i] == len(brute.template(t, templates.NAMES, templates.UNITS))
