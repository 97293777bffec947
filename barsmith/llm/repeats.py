"""Removal of long repeated byte strings, by difference-cover blockwise sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed.  Sorting all suffixes would move a row per byte; instead

1. *Cover sample.*  Positions whose offset modulo v is in a difference cover D
   are sampled (|D| of v, about 9% at the default).  Any two positions have a
   common shift below v that moves both into the sample, so two equal strings
   of ``length`` bytes hold two equal sampled strings of ``length - v + 1``
   bytes.  The sample is sorted blockwise: a block is one bucket of the hashed
   string, all of its entries meet in one task, and an entry's rank says
   whether it is tied.
2. *Suffixes.*  Only starts within v of a tied sample can be long ties.  For
   those the whole string of ``length`` bytes is hashed and the buckets are
   sorted again, one at a time; equal neighbours are repeats.

Blocks are those of :mod:`barsmith.llm.postings`: packed arrays, and one marker
a task for what is equal within it.  Before the second sort, texts that share
their smallest window hash are brought into one task, so that most repeats are
settled there; large families are split by size.  Equal texts are settled
beforehand by their fingerprint: one of them goes into the sort.  Texts move
only if a fixed-size sieve lets them through.  Strings are compared by 64-bit
hashes within hash buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import cut, may_have, sieve
from barsmith.llm.postings import SENT, Postings, find_ties, places
from barsmith.llm.shingles import mixed

#: bytes hashed at a time
SEGMENT = 1 << 18
#: bytes of the windows by which texts of one family are brought together
FAMILY = 48
BASE = 0x9E3779B97F4A7C15


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """``(v, D)`` of Colbourn and Ling: 6r + 4 residues whose differences are
    all residues modulo v = 24r^2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0] + steps)


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover that leaves at least half of ``length`` to compare."""
    r = 0
    while 2 * difference_cover(r + 1)[0] <= length + 1:
        r += 1
    return difference_cover(r)


class Rolling:
    """Hashes of all windows of a byte string, a segment at a time."""

    def __init__(self, width: int):
        self.width = width
        n = SEGMENT + width
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, BASE, np.uint64))
            self.down = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
        self.table = mixed(np.arange(1, 257, dtype=np.uint64), 7)

    def __call__(self, data: np.ndarray):
        """``(offset, hashes of the windows that start there and on)``."""
        w = self.width
        for at in range(0, len(data) - w + 1, SEGMENT):
            x = self.table[data[at:at + SEGMENT + w - 1]]
            x *= self.up[:len(x)]
            h = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=h[1:])
            yield at, mixed((h[w:] - h[:-w]) * self.down[:len(h) - w])


def _sample_task(length: int, slots: int):
    def run(batches):
        v, cover = cover_for(length)
        roll, out = Rolling(length - v + 1), Postings(slots, 5)
        chosen = np.zeros(v, bool)
        chosen[cover] = True
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not out.new(key):
                    continue
                for at, h in roll(np.frombuffer(text.as_buffer(), np.uint8)):
                    pos = np.arange(at, at + len(h))
                    pos = pos[chosen[pos % v]]
                    out.add(key, h[pos - at], pos)
                if out.full():
                    yield from out.send()
        yield from out.send()
    return run


def _family_task(batches):
    """Adds the smallest hash of all short windows: texts that share most of
    their content are likely to share it."""
    roll = Rolling(FAMILY)
    for batch in batches:
        low = [min((int(h.min()) for _, h in roll(np.frombuffer(t.as_buffer(), np.uint8))), default=0)
               for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(low, np.uint64).view(np.int64))],
                                         names=[*batch.schema.names, "family"])


def _suffix_task(length: int, slots: int):
    def run(batches):
        v, _ = cover_for(length)
        roll, out = Rolling(length), Postings(slots, 8)
        for batch in batches:
            for key, text, tied in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if not out.new(key):
                    continue
                data = np.frombuffer(text.as_buffer(), np.uint8)
                p = places(tied).astype(np.int64)
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, np.maximum(p - v + 1, 0), 1)
                np.add.at(step, p + 1, -1)
                near = np.cumsum(step)[:len(data) - length + 1] > 0
                for at, h in roll(data):
                    pos = np.flatnonzero(near[at:at + len(h)])
                    if len(pos):
                        out.add(key, h[pos], pos + at)
                    if out.full():
                        yield from out.send()
        yield from out.send()
    return run


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` bytes at these starts."""
    s = np.unique(starts).astype(np.int64)
    if not len(s):
        return s, s
    first = np.append(True, s[1:] > s[:-1] + length)
    last = np.append(first[1:], True)
    return s[first], s[last] + length


def _remove_task(length: int):
    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_bytes": [], "starts": [], "ends": [], "kept": []}
            for text, copied, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.as_py() or b""
                if copied:
                    a, b = np.array([0]), np.array([len(data)])
                else:
                    a, b = spans_of(places(found) if found else np.zeros(0, np.uint32), length)
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                out["n_bytes"].append(len(data))
                out["starts"].append(a)
                out["ends"].append(b)
                out["kept"].append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([x if k == "doc_id" else pa.array(x, t) for (k, x), t
                                              in zip(out.items(), kinds)], names=list(out))
    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept`` (binary) for every row.

    Null and empty texts have no bytes and lose none, nor do texts shorter than
    ``length``.  Matches never cross texts; overlaps count, and a string that
    occurs twice in one text is a repeat.  Equal texts, repeated rows included,
    lose all their bytes if they are long enough.  Null ids are passed on; only
    the two named columns are read."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("__text"))
    d = d.withColumn("key", F.xxhash64("__text"))
    long = F.octet_length("__text") >= length
    texts = cut(d.where(long).groupBy("key", F.xxhash64(F.lit(1), F.col("__text")).alias("key2")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sort_blocks(sent: DataFrame, width: int) -> DataFrame:
        return cut(find_ties(sent, width, slots).select("key", "pos"))

    tied = sort_blocks(d.where(long).select("key", "__text").mapInArrow(_sample_task(length, slots), SENT), 5)
    rep = texts.join(tied, "key").select(F.col("key").alias("__key"), F.col("doc_id").alias("__rep"), "pos")
    held = may_have(d.where(long), "key", tied, "key")
    held = held.join(rep, (held["key"] == rep["__key"]) & held["doc_id"].eqNullSafe(rep["__rep"])).select(
        "key", "__text", "pos").mapInArrow(_family_task, "key long, __text binary, pos binary, family long")
    # families side by side, split where they are large: most repeats are then settled within a task
    held = held.hint("rebalance", "family").sortWithinPartitions("family").select("key", "__text", "pos")
    found = sort_blocks(held.mapInArrow(_suffix_task(length, slots), SENT), 8)

    many = texts.where("copies > 1").select("key", F.lit(True).alias("copied"))
    hit = cut(found.join(many, "key", "full").select("key", F.coalesce("copied", F.lit(False)).alias("copied"), "pos"))
    inside, outside = sieve(d, "key", hit, "key")
    none = F.array().cast("array<long>")
    rest = outside.select("doc_id", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes"),
                          none.alias("starts"), none.alias("ends"),
                          F.coalesce("__text", F.lit(b"")).alias("kept"))
    cutdown = inside.join(hit, "key", "left").select("doc_id", "__text", F.coalesce("copied", F.lit(False)), "pos")
    return rest.unionByName(cutdown.mapInArrow(
        _remove_task(length), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"))


def digest_repeats(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return remove_repeats(docs, **how).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
