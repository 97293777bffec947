"""Language prediction against a plain version: vectors bound and bundled
letter by letter, cosines by the definition."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barsmith.llm import common, langid

DOC = "doc_id long, text string, lang string"
DIM = 128


def brute(rows, dim=DIM):
    letters = np.random.default_rng(7).integers(0, 2, (langid.SYMBOLS, dim), np.int8).astype(np.int64) * 2 - 1
    table = langid.symbol_table()

    def vector(text):
        total, found = np.zeros(dim), 0
        s = [int(table[ord(c)]) for c in (text or "").lower()]
        s = [0, *s, 0]
        s = [x for i, x in enumerate(s) if i == 0 or x or s[i - 1]]          # runs of other characters are one
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
                found += 1
        return total, found
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, _, _ in rows}
    sums = {}
    for i, text, lang in rows:
        if not held[i] and lang is not None and text is not None:
            v, n = vector(text)
            if n:
                sums[lang] = sums.get(lang, 0) + v
    out = []
    for i, text, _ in rows:
        v, n = vector(text)
        if not n or not sums:
            out.append((i, held[i], "und", 0.0))
            continue
        cos = {k: float(p @ v / (np.linalg.norm(p) * max(np.linalg.norm(v), 1e-9))) for k, p in sums.items()}
        best = max(sorted(cos), key=lambda k: cos[k])
        out.append((i, held[i], best, min(1.0, max(0.0, cos[best]))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_predictions_match_brute(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(langid, "VECTORS", 40)
        monkeypatch.setattr(langid, "SLAB", 16)
    rnd = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "wh", "and"], "fr": ["é", "eau", "que", "ça", "les"], "de": ["ü", "ung", "sch", "ß", "und"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[la]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 40))) + rnd.choice([".", " 12!", "\n"]),
             rnd.choice([la, la, la, None])) for i, la in enumerate(rnd.choice(list(parts)) for _ in range(80))]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 + 3\n", "fr"), (None, "the whing", "en"), (3, rows[3][1], "de"),
             (103, "Größe ΑΒΓ жшд " * 50, None), (104, "a", None)]
    got = langid.identify(spark.createDataFrame(rows, DOC).repartition(3), dim=DIM).collect()
    want = brute(rows)
    key = lambda r: (str(r[0]), str(r[2]), round(r[3], 6))
    a = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in got), key=key)
    b = sorted(want, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-6)


def test_texts_go_to_python_in_bounded_batches(spark):
    """Long texts go a few at a time; a bound that the session has stays."""
    rows = spark.range(3000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    def largest():
        langid.identify(rows).count()
        return rows.select("text").mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
    spark.conf.unset(common.BATCH_BYTES)
    assert largest() < 3 << 20
    spark.conf.set(common.BATCH_BYTES, "64m")
    try:
        assert largest() > 8 << 20
    finally:
        spark.conf.unset(common.BATCH_BYTES)
