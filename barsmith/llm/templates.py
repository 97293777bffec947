"""Benchmark decontamination by canonical templates.

Numbers, names and units are replaced by typed placeholders, so a question that
was asked again with other values has the same template.  Windows of ``WIDTH``
template tokens are hashed, and windows that hold slots also with their values,
in lower case; benchmark windows and document windows meet in a hash join, and
on each diagonal (document position less item position) the slots are checked:
a value of the item must stand for one value of the document.  Windows with
slots in conflict do not count; windows with the item's own values always do.

* A document is a leak of an item if it matches at least half of the item's
  windows with ``LITERALS`` literals, or has at least half of all its windows
  word by word.
* An item that needs ``a`` of its ``n`` windows must match one of any
  ``n - a + 1``, so pairs are proposed by each item's rarest windows only (of
  either kind); a
  phrase that many items share proposes nothing.  All windows of the proposed
  pairs are then compared.
* Documents are read once.  A Bloom filter of fixed size over the benchmark's
  hashes, not the benchmark, is sent to the tasks; what passes is joined.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import bounded_batches, cut, passes_columns, sieve
from barsmith.llm.shingles import grouped, mixed

WIDTH = 8
#: literal tokens that a window must have to be evidence with other values
LITERALS = 4
#: bits of the filter that is sent to the tasks
FILTER = 1 << 22

#: Units that may follow a number, signs that are units anywhere.
UNITS = frozenset("""mm cm m km in inch inches ft feet yd yard yards mi mile miles mg g kg gram grams ton tons
    lb lbs oz pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hour hours
    day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph""".split())
SIGNS = frozenset("%$€£")
#: Given names taken as names at the start of a sentence too.
NAMES = frozenset("""Adam Alice Amy Anna Ben Bob Carlos Chris Clara Dan David Emma Eric Eva Frank Grace Hannah
    Henry Ivan Jack James Jane Jim Joe John Julia Karen Kate Kevin Laura Leo Lisa Lucy Maria Mark Mary Mia Mike
    Nina Nora Oliver Olivia Paul Peter Rosa Ryan Sam Sara Sarah Sofia Steve Susan Tim Tom Tony Victor""".split())
WORD, CAPITAL, NUMBER, UNIT, SIGN, END, NAME = range(7)
#: tokens of the placeholders
SLOT = {NUMBER: np.uint64(11), UNIT: np.uint64(13), NAME: np.uint64(17)}

#: characters that are tokenised at a time
SLAB = 1 << 18
#: classes of characters, 0 for all others
LETTER, DIGIT, STOP, MONEY = 1, 2, 3, 4
BASE = np.uint64(0x9E3779B97F4A7C15)


class Characters:
    """What each character is, and its lower case (where that is one character)."""

    def __init__(self):
        self.power = np.ones((2, 1), np.uint64)
        self._tables(0x10000)
        self.units, self.names = (np.sort(np.concatenate([self.scan(w)[0] for w in sorted(words)])) for words in (UNITS, NAMES))

    def _tables(self, n: int) -> None:
        every = [chr(c) for c in range(n)]
        lower = [c.lower() for c in every]
        self.kind = np.array([DIGIT if c.isdecimal() else LETTER * c.isalnum() for c in every], np.int8)
        self.case = np.array([c.isupper() - c.islower() for c in every], np.int8)      # 1 upper, -1 lower
        self.lower = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(lower)], np.uint64)
        self.inner = np.zeros(n, np.int8)
        for table, chars, kind in ((self.kind, ".!?\n", STOP), (self.kind, "%$€£", MONEY),
                                   (self.inner, "'’-", LETTER), (self.inner, ".,:/", DIGIT)):
            table[[ord(c) for c in chars]] = kind

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd number and of its inverse modulo 2^64."""
        if self.power.shape[1] <= n:
            by = np.full((2, max(n, SLAB) + 1), BASE)
            by[1], by[:, 0] = np.uint64(pow(int(BASE), -1, 1 << 64)), 1
            self.power = np.cumprod(by, axis=1)
        return self.power[0], self.power[1]

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (in lower case, the last three bits zero), kind and first
        character of each token: words (with inner ' or -), numbers (with inner
        .,:/), ends of sentences and money signs."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c)
        if n and c.max() >= len(self.kind):
            self._tables(0x110000)
        up, down = self._powers(n)
        kind = self.kind[c]
        at = np.flatnonzero(self.inner[c])
        at = at[(at > 0) & (at < n - 1)]
        inner = self.inner[c[at]]
        at = at[(kind[at - 1] == inner) & (kind[at + 1] == inner)]
        kind[at] = kind[at - 1]
        change = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] >= STOP)) if n else np.zeros(0, bool))
        of = kind[change]
        first, edge, of = change[of > 0], np.append(change[1:], n)[of > 0], of[of > 0]
        total = np.append(np.uint64(0), np.cumsum(self.lower[c] * up[:n]))
        h = (total[edge] - total[first]) * down[first]
        h = mixed(h + (edge - first).astype(np.uint64)) & ~np.uint64(7)
        out = np.array([0, WORD, NUMBER, END, SIGN], np.int8)[of]
        case = self.case[c]
        maybe = np.flatnonzero((of == LETTER) & (case[first] == 1))
        a, b = first[maybe], edge[maybe]
        uppers, lowers = (np.append(0, np.cumsum(case == v, dtype=np.int32)) for v in (1, -1))
        maybe = maybe[(uppers[b] - uppers[a] == 1) & (lowers[b] > lowers[a])]
        if hasattr(self, "names"):
            out[maybe[~_in(h[maybe], self.units)]] = CAPITAL
            out[maybe[_in(h[maybe], self.names)]] = NAME
        return h, out, first


@functools.cache
def characters() -> Characters:
    """One a worker."""
    return Characters()


def _in(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def _pieces(texts: list[str | None]):
    """``(string, texts its parts are of, where they start)``: many short texts
    at a time, a long one in parts cut at white space."""
    held, of, start, size = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + SLAB
            while end < len(text) and not text[end].isspace():
                end += 1
            held, of, start = held + [text[at:end]], of + [i], start + [size]
            size += len(held[-1]) + 1
            at = end
            if size >= SLAB:
                yield "\0".join(held), np.array(of), np.array(start)
                held, of, start, size = [], [], [], 0
    if held:
        yield "\0".join(held), np.array(of), np.array(start)


class Templates:
    """Template tokens of many texts, one after the other: ``t`` (placeholders
    for slots), ``values`` (hash of what stands in a slot, 0 for literals) and
    ``text`` (which of the texts a token is of)."""

    def __init__(self, texts: list[str | None], characters: Characters):
        parts = [(*characters.scan(s), of, start) for s, of, start in _pieces(texts)]
        h = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
        kind = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int8)])
        text = np.concatenate([of[np.searchsorted(start, at, "right") - 1] for _, _, at, of, start in parts]
                              or [np.zeros(0, np.int64)])
        before = np.append(np.int8(END), kind[:-1])[:len(kind)]
        before[1:][text[1:] != text[:-1]] = END
        is_name = (kind == NAME) | ((kind == CAPITAL) & (before != END))
        is_unit = kind == SIGN
        after = np.flatnonzero((before == NUMBER) & ((kind == WORD) | (kind == CAPITAL)))
        is_unit[after[_in(h[after], characters.units)]] = True
        is_name &= ~is_unit
        values = np.zeros(len(h), np.uint64)
        for mask, slot in ((kind == NUMBER, NUMBER), (is_unit, UNIT), (is_name, NAME)):
            values[mask] = h[mask] | np.uint64(1)
            h[mask] = SLOT[slot]
        keep = kind != END
        self.t, self.values, self.text = h[keep], values[keep], text[keep]
        #: where each text's tokens begin, and where the last ends
        self.start = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Hashes of the windows with enough literals, then of the windows that
        hold slots with the values in place of the placeholders; where they
        start; and how many are of the first kind.  Without slots both hashes
        are one.  No window reaches into the next text."""
        n = len(self.t) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        whole = self.text[:n] == self.text[width - 1:]
        literal = np.append(0, np.cumsum(self.values == 0))
        literal = literal[width:] - literal[:-width]
        enough = whole & (literal >= min(LITERALS, width))
        found = []
        for tokens, at in ((self.t, np.flatnonzero(enough)),
                           (np.where(self.values == 0, self.t, self.values ^ np.uint64(1)),
                            np.flatnonzero(whole & (literal < width)))):
            h, m = np.full(n, np.uint64(width)), mixed(tokens)
            for i in range(width if len(at) else 0):
                h = h * np.uint64(0x100000001B3) + m[i:i + n]
            found.append((mixed(h[at], width), at))
        return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found]), int(enough.sum())


ITEM = "item_id long, hash long, pos int, values binary, total int, width int, same long, raw boolean, raw_total int"


def _item_task(batches):
    known = characters()
    for batch in batches:
        out = {k.split()[0]: [] for k in ITEM.split(", ")}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = Templates([text.as_py()], known)
            n = len(x.t)
            if not n:
                continue
            width = min(WIDTH, n)
            h, at, total = x.windows(width)
            same = int(np.bitwise_xor.reduce(mixed(mixed(x.t) + x.values + np.arange(n, dtype=np.uint64)), initial=0))
            for i, (hash_, p) in enumerate(zip(h.view(np.int64).tolist(), at.tolist())):
                row = (item, hash_, p, x.values[p:p + width].tobytes(), total, width, int(np.uint64(same).view(np.int64)),
                       i >= total, n - width + 1)
                for k, v in zip(out, row):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


HIT = "key long, doc_id long, hash long, dpos int, dvalues binary"


def _slabs(batch):
    """Rows of a batch with about a slab of text each time."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy()))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + SLAB, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _doc_task(shared):
    def run(batches):
        known, (bits, widths) = characters(), shared.value
        for batch in batches:
            for rows in _slabs(batch):
                x = Templates(rows.column(2).to_pylist(), known)
                for width in widths:
                    h, at, _ = x.windows(width)
                    may = np.flatnonzero(bits[_bit(h, 0)])
                    may = may[bits[_bit(h[may], 1)]]
                    if len(may):
                        h, at = h[may], at[may]
                        row = pa.array(x.text[at])
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(0).take(row), rows.column(1).take(row), pa.array(h.view(np.int64)),
                             pa.array((at - x.start[x.text[at]]).astype(np.int32)),
                             pa.array([x.values[p:p + width].tobytes() for p in at.tolist()], pa.binary())],
                            names=["key", "doc_id", "hash", "dpos", "dvalues"])
    return run


def _bit(h: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(h, 20 + salt) & np.uint64(FILTER - 1)).astype(np.int64)


def _bits_task(batches):
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_pydict({"bit": pa.array(np.unique(np.concatenate([_bit(h, 0), _bit(h, 1)])))})


def _equal_and_consistent(a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows (rows) of a diagonal, which hold the item's own values,
    and which hold only slots whose item value stands for one document value
    there.  That is the value most of its slots have, its own if as many have
    another; with no such value all its slots are in conflict."""
    equal = (a == b).all(axis=1) | (a == 0).all(axis=1)      # without slots by hash
    fits = ((a == 0) == (b == 0)).all(axis=1)
    at = (pos[:, None] + np.arange(a.shape[1]))[a != 0]
    _, once = np.unique(at, return_index=True)
    pairs, seen = np.unique(np.stack([a[a != 0][once], b[a != 0][once]], 1), axis=0, return_counts=True)
    stands, votes = {}, {}
    for (x, y), n in zip(pairs.tolist(), (2 * seen).tolist()):
        n += x == y
        if n >= votes.get(x, 0):
            stands[x] = None if n == votes.get(x) else y
            votes[x] = n
    if len(pairs):
        right = np.array([stands[x] == y for x, y in pairs.tolist()])
        wrong = {tuple(p) for p in pairs[~right].tolist()}
        if wrong:
            fits &= np.array([not any((x, y) in wrong for x, y in zip(r, q)) for r, q in zip(a.tolist(), b.tolist())])
    return equal, equal | fits


PAIR = "key long, doc_id long, item_id long, matched int, windows int, reworded boolean, dpos int"


def _check_task(need: float):
    """Diagonals of the proposed pairs, sorted by key, item and diagonal."""
    def run(batches):
        for (key, _), rows in grouped(batches, ["key", "same"]):
            diag, pos = rows.column("diag").to_numpy(), rows.column("pos").to_numpy()
            raw, literal = (rows.column(c).to_numpy() for c in ("raw", "literal"))
            a, b = (np.stack([np.frombuffer(x, np.uint64) for x in rows.column(c).to_pylist()])
                    for c in ("values", "dvalues"))
            equal, fits = raw.copy(), raw.copy()
            for d in np.unique(diag[~raw]):
                at = np.flatnonzero((diag == d) & ~raw)
                equal[at], fits[at] = _equal_and_consistent(a[at], b[at], pos[at])
            total, every = rows.column("total")[0].as_py(), rows.column("raw_total")[0].as_py()
            matched, verbatim = len(np.unique(pos[fits & literal])), len(np.unique(pos[equal]))
            if not total or matched < need * total:
                matched, total, fits = verbatim, every, equal
            if matched and matched >= need * total:
                copied = set(zip(diag[equal].tolist(), pos[equal].tolist()))
                reworded = any(x not in copied for x in zip(diag[fits].tolist(), pos[fits].tolist()))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key], pa.int64()), "doc_id": rows.column("doc_id").slice(0, 1).combine_chunks(),
                    "item_id": rows.column("item_id").slice(0, 1).combine_chunks(), "matched": pa.array([matched], pa.int32()),
                    "windows": pa.array([total], pa.int32()), "reworded": pa.array([reworded]),
                    "dpos": pa.array([int((pos + diag)[fits].min())], pa.int32())})
    return run


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", need: float = 0.5) -> DataFrame:
    """``key, doc_id, item_id, matched, windows, reworded, dpos`` for every
    document that holds at least ``need`` of an item's windows; ``reworded``
    says that slots differ, ``dpos`` is the first template token.

    Null and empty texts hold nothing and are no items; an item of fewer than
    ``WIDTH`` tokens is one window.  Items whose windows all lack literals
    (so of those with fewer than ``LITERALS`` tokens, the ones with slots)
    are found word by word only, not with other values; so are names in a text
    that changes their case.  Items with equal templates and values
    are one, under the smallest id; one id with two texts is two items (items
    with a null id are not reported).  ``key`` is a hash of id and text: repeated rows are one
    document, rows with one id and different texts are two."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = cut(benchmark.where(F.col(item_id).isNotNull())
                .select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text))
                .mapInArrow(_item_task, ITEM))
    items = items.groupBy("same", "pos", "raw").agg(
        F.min("item_id").alias("item_id"),
        *(F.first(c).alias(c) for c in ("hash", "values", "total", "width", "raw_total")))
    common = items.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    place = Window.partitionBy("same", "pos")                                             # within one item
    items = items.join(common, "hash").withColumn("literal", F.max(~F.col("raw")).over(place)) \
        .withColumn("most", F.max("df").over(place)) \
        .withColumn("whole", F.col("raw") | (F.count(F.lit(1)).over(place) == 1))         # one a place
    by_place = F.dense_rank().over(Window.partitionBy("same", "literal").orderBy("most", "pos"))
    by_whole = F.row_number().over(Window.partitionBy("same", "whole").orderBy("df", "hash", "pos"))

    def rarest(rank, total):
        return rank <= F.col(total) - F.greatest(F.lit(1), F.ceil(F.col(total) * F.lit(need))) + 1
    items = cut(items.withColumn("proposes", (F.col("literal") & rarest(by_place, "total"))
                                 | (F.col("whole") & rarest(by_whole, "raw_total"))))

    bits = np.zeros(FILTER, bool)
    for r in items.select("hash").distinct().mapInArrow(_bits_task, "bit long").distinct().toLocalIterator():
        bits[r["bit"]] = True
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    d = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
                    F.col(text).alias("__text"))
    hits = cut(d.mapInArrow(_doc_task(spark.sparkContext.broadcast((bits, widths))), HIT)
               .join(items.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["key", "dpos", "hash"]))
    pairs = hits.join(items.where("proposes").select("hash", "same"), "hash").select("key", "same").distinct()
    both = pairs.join(hits, "key").join(items, ["same", "hash"]).select(
        "key", "same", "item_id", (F.col("dpos") - F.col("pos")).alias("diag"), "pos", "values", "dvalues", "total", "doc_id",
        "raw", "literal", "raw_total")
    return both.repartition("key", "same").sortWithinPartitions("key", "same").mapInArrow(
        _check_task(need), PAIR)


@passes_columns
def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that leak an item of the benchmark."""
    found = cut(leaks(docs, benchmark, doc_id=doc_id, text=text, **how).select(F.col("key").alias("__leak")).distinct())
    inside, outside = sieve(docs.withColumn("__key", row_key(doc_id, text)), "__key", found, "__leak")
    clean = inside.join(found, F.col("__key") == F.col("__leak"), "left_anti")
    return outside.unionByName(clean).drop("__key")
