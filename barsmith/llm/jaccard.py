"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, whatever order the tokens of all documents are
put in.  All orders used here begin with the tokens of a single document, then
come the others, the very frequent ones last; within that, each order is
another hash.

1. Tokens of a single document are found by sorting all tokens a block at a
   time (:mod:`barsmith.llm.postings`).  A set whose prefix they fill has no
   partner; of the others only the shared tokens are kept, which is all that an
   intersection can hold.
2. Per order, documents that share a prefix token are linked and the links
   closed to classes.  A pair can only be similar if it is in one class under
   *every* order, so the classes are intersected before sets are compared.
3. A class is cut into bands of set size (similar sets are in one band or in
   neighbours) and those into blocks of bounded size; a task compares two
   blocks by a matrix product over the tokens they share and returns a spanning
   star of what it finds.  Every pair of a class whose sizes allow it meets in
   some task: no cap on partners, none is lost.

Documents with equal sets are one node from the start.  A token that a third of
all documents have costs one entry a task; links are stars, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import SPACE, bounded_batches, cut, may_have, passes_columns, sieve
from barsmith.llm.graph import components
from barsmith.llm.postings import SENT, Postings, find_ties, places
from barsmith.llm.shingles import WordHashes, binary, grouped, mixed, pack, shingle_set, unpack

#: cells of the count sketch; tokens over LIFT times the mean are put last
CELLS = 1 << 21
LIFT = 4
#: postings held in a task before they are sent on
HELD = 1 << 20
#: documents and shingles of a block
BLOCK_DOCS = 1024
BLOCK_TOKENS = 2_000_000
#: columns of a block's matrix at a time
COLUMNS = 8192


def need(n, percent: int):
    """Tokens that two sets of n tokens or more must share at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - need(n, percent) + 1


# -- shared tokens -------------------------------------------------------------

NONE = -(1 << 63)


def set_print(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set, as two signed numbers."""
    sums = np.array([mixed(s, k).sum(dtype=np.uint64) for k in (1, 2)], np.uint64).view(np.int64)
    return int(sums[0]), int(sums[1])


def _first_task(n: int, slots: int):
    """All tokens to their blocks; id, size and fingerprint of every set along."""
    def run(batches):
        cache, out = WordHashes(), Postings(slots, 4)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), n, cache)
                fp = set_print(s)
                out.note(np.array([NONE if doc is None else doc, len(s), *fp], np.int64).tobytes())
                if len(s) and doc is not None and out.new(fp[0]):
                    out.add(fp[0], s, np.arange(len(s)))
                if out.full():
                    yield from out.send()
        yield from out.send()
    return run


def _digest_task(batches):
    for batch in batches:
        x = binary(batch.column(0), np.int64).reshape(-1, 4)
        ids = pa.array(np.ascontiguousarray(x[:, 0]), mask=x[:, 0] == NONE)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(x[:, k])) for k in (1, 2, 3))],
                                         names=["doc_id", "n", "fp1", "fp2"])


MEMBER = "doc_id long, fp1 long, n long, tokens binary"


def _member_task(n: int):
    """The shared tokens of the sets that may have a partner."""
    def run(batches):
        cache = WordHashes()
        for batch in batches:
            out = {k.split()[0]: [] for k in MEMBER.split(", ")}
            for doc, fp1, text, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = shingle_set(text, n, cache)
                if set_print(s)[0] != fp1:
                    continue                         # another row with this id
                shared = places(at)
                for k, v in zip(out, (doc, fp1, len(s), s[shared].tobytes())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "tokens" else pa.int64())
                                              for k, v in out.items()], names=list(out))
    return run


# -- the order ---------------------------------------------------------------

PARTS = 32
STEP = CELLS // PARTS


def _sketch_task(batches):
    cells, held, size = np.zeros(CELLS, np.uint32), [], 0

    def count():
        at = (np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64)
        return np.bincount(at, minlength=CELLS).astype(np.uint32)
    for batch in batches:
        held.append(binary(batch.column(0), np.uint64))
        size += len(held[-1])
        if size > CELLS:
            cells += count()
            held, size = [], 0
    if held:
        cells += count()
    at = np.flatnonzero(cells).astype(np.uint32)
    for part in range(PARTS if len(at) else 0):
        mine = at[(at >= part * STEP) & (at < (part + 1) * STEP)]
        if len(mine):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()),
                "cells": pa.array([pack(mine - np.uint32(part * STEP))], pa.binary()),
                "counts": pa.array([pack(cells[mine].astype(np.uint64))], pa.binary())})


def _sum_parts(batches):
    for (part,), rows in grouped(batches, ["part"]):
        cells = np.zeros(STEP, np.uint64)
        for at, counts in zip(rows.column("cells").to_pylist(), rows.column("counts").to_pylist()):
            cells[unpack(at, np.uint32)] += unpack(counts, np.uint64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                          "counts": pa.array([pack(cells)], pa.binary())})


def token_classes(members: DataFrame) -> np.ndarray:
    """Class of every sketch cell (0 for all but the frequent ones).  The
    sketch has a fixed size, whatever the corpus; it steers the cost of the
    search, never its result."""
    sums = members.select("tokens").mapInArrow(_sketch_task, "part int, cells binary, counts binary") \
        .repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(
            _sum_parts, "part int, counts binary").collect()
    mean = sum(float(unpack(bytes(r["counts"]), np.uint64).sum()) for r in sums) / CELLS
    classes = np.zeros(CELLS, np.uint8)
    for r in sums:
        over = unpack(bytes(r["counts"]), np.uint64) / (LIFT * mean + 16)
        late = np.where(over > 1, np.minimum(1 + 2 * np.log2(np.maximum(over, 1)), 60), 0)
        classes[r["part"] * STEP:(r["part"] + 1) * STEP] = late.astype(np.uint8)
    return classes


# -- links under each order ----------------------------------------------------

class _Held:
    """Postings and links of a task, by order and token bucket."""

    def __init__(self, slots: int):
        self.slots, self.size, self.tokens, self.docs = slots, 0, {}, {}

    def add(self, order: int, tokens: np.ndarray, doc: int) -> None:
        self.tokens.setdefault(order, []).append(tokens)
        self.docs.setdefault(order, []).append(np.full(len(tokens), doc, np.int64))
        self.size += len(tokens)

    def send(self):
        out = {"slot": [], "tokens": [], "docs": [], "left": [], "right": []}
        for order in self.tokens:
            t, d = np.concatenate(self.tokens[order]), np.concatenate(self.docs[order])
            t, d, a, b = _stars(t, d)
            slot, slot_of_link = (x % np.uint64(self.slots) for x in (mixed(t, 99), mixed(b.view(np.uint64), 98)))
            by, by_link = np.argsort(slot, kind="stable"), np.argsort(slot_of_link, kind="stable")
            cut_at = np.searchsorted(slot[by], np.arange(self.slots + 1, dtype=np.uint64))
            cut_link = np.searchsorted(slot_of_link[by_link], np.arange(self.slots + 1, dtype=np.uint64))
            t, d, a, b = t[by], d[by], a[by_link], b[by_link]
            for s in range(self.slots):
                i, j, k, m = cut_at[s], cut_at[s + 1], cut_link[s], cut_link[s + 1]
                if j > i or m > k:
                    out["slot"].append(order * self.slots + s)
                    for name, x in (("tokens", t[i:j]), ("docs", d[i:j]), ("left", a[k:m]), ("right", b[k:m])):
                        out[name].append(x.tobytes())
        self.size, self.tokens, self.docs = 0, {}, {}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "slot" else pa.binary())
                                          for k, v in out.items()})


def _stars(tokens: np.ndarray, docs: np.ndarray):
    """One posting per token (its smallest document), and distinct links from
    it to the token's other documents."""
    by = np.lexsort((docs, tokens))
    tokens, docs = tokens[by], docs[by]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    lead = docs[first][np.cumsum(first) - 1] if len(docs) else docs
    a, b = _distinct(lead[~first], docs[~first])
    return tokens[first], docs[first], a, b


def _distinct(a: np.ndarray, b: np.ndarray):
    keep = a != b
    a, b = a[keep], b[keep]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _postings_task(percent: int, orders: int, slots: int, classes):
    def run(batches):
        held, cls = _Held(slots), classes.value
        for batch in batches:
            for node, n, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = np.frombuffer(tokens, np.uint64)
                p = prefix_length(n, percent) - (n - len(s))     # single tokens come first
                if p < 1:
                    continue
                late = cls[s & np.uint64(CELLS - 1)].astype(np.uint64)
                for k in range(orders):
                    rank = (mixed(s, 10 + k) >> np.uint64(6)) | (late << np.uint64(58))
                    held.add(k, s[np.argpartition(rank, p - 1)[:p]] if p < len(s) else s, node)
                if held.size >= HELD:
                    yield from held.send()
        if held.size:
            yield from held.send()
    return run


def _links_task(slots: int):
    def run(batches):
        for (slot,), rows in grouped(batches, ["slot"]):
            _, _, a, b = _stars(binary(rows.column("tokens"), np.uint64), binary(rows.column("docs"), np.int64))
            a, b = _distinct(np.concatenate([a, binary(rows.column("left"), np.int64)]),
                             np.concatenate([b, binary(rows.column("right"), np.int64)]))
            if len(a):
                yield pa.RecordBatch.from_pydict({"order": pa.array(np.full(len(a), slot // slots, np.int32)),
                                                  "a": pa.array(a), "b": pa.array(b)})
    return run


# -- verification --------------------------------------------------------------

def _verify_task(percent: int):
    def run(batches):
        for _, rows in grouped(batches, ["cls", "pair"]):
            sets = [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]
            a, b = _similar(rows.column("doc_id").to_numpy(), rows.column("n").to_numpy(), sets, percent)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})
    return run


def _similar(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int):
    """A spanning star for each group of sets connected by similarity; sizes
    are of the whole sets, which hold the shared tokens given."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[col] > 1
    owner, col = owner[keep], col[keep]
    _, col = np.unique(col, return_inverse=True)
    shared = np.zeros((m, m), np.float32)
    by = np.argsort(col, kind="stable")
    owner, col = owner[by], col[by]
    width = int(col[-1]) + 1 if len(col) else 0
    for start in range(0, width, COLUMNS):
        i, j = np.searchsorted(col, [start, start + COLUMNS])
        part = np.zeros((m, min(COLUMNS, width - start)), np.float32)
        part[owner[i:j], col[i:j] - start] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    near = 100 * shared.astype(np.int64) >= percent * union.astype(np.int64)
    np.fill_diagonal(near, True)
    label, changed = np.arange(m), True
    while changed:
        low = np.where(near, label[None, :], m).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        changed = bool((new != label).any())
        label = new
    a, b = ids[label], ids
    return a[a != b], b[a != b]


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Each document with its class, once for every pair of blocks it is in.

    Sizes fall in bands whose ends differ by a little over 100 / percent, so that
    similar sets are in one band or in neighbours.  A class that fits one block
    is one block.  Larger ones are dealt by hash to as many blocks per band as
    bound documents and shingles; blocks meet within a band and with the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    s = sets.withColumn("band", band)
    fill = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    whole = cut(s.groupBy("cls").agg(fill().alias("parts"), F.count(F.lit(1)).alias("docs")).where("docs > 1"))
    bands = s.join(whole.where("parts > 1").select("cls"), "cls", "left_semi").groupBy("cls", "band").agg(
        fill().alias("parts"))
    bands = cut(bands)
    one = s.join(whole.where("parts = 1").select("cls"), "cls").select(
        "doc_id", "fp1", "cls", F.lit("").alias("pair"))
    nxt = bands.select("cls", (F.col("band") - 1).alias("band"), F.col("parts").alias("next"))
    prev = bands.select("cls", (F.col("band") + 1).alias("band"), F.col("parts").alias("prev"))
    many = (s.join(bands, ["cls", "band"]).join(nxt, ["cls", "band"], "left").join(prev, ["cls", "band"], "left")
            .withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))

    def upto(top):
        return F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.array().cast("array<int>"))

    def tag(lo_band, lo, hi):
        return F.concat_ws(":", lo_band, lo, hi)
    own = F.transform(upto(F.col("parts")), lambda x: tag(
        F.col("band"), F.least(x, F.col("mine")), F.greatest(x, F.col("mine"))))
    up = F.transform(upto(F.coalesce("next", F.lit(0))), lambda x: tag(F.col("band"), F.col("mine"), F.concat(F.lit("+"), x)))
    down = F.transform(upto(F.coalesce("prev", F.lit(0))), lambda x: tag(
        F.col("band") - 1, x, F.concat(F.lit("+"), F.col("mine"))))
    many = many.select("doc_id", "fp1", "cls", F.explode(F.concat(own, up, down)).alias("pair"))
    return one.unionByName(many)


def near_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                 percent: int = 80, orders: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Texts without words (null, empty, blank) have an empty set and link with
    nothing; fewer words than a shingle are one shingle.  ``component_id`` is
    the smallest id reachable over links.  Rows with one id are one document
    for reaching; a row with a null id is counted but links nothing, its
    component is null.  Only the two named columns are read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    first = cut(find_ties(d.mapInArrow(_first_task(words, slots), SENT), 4, slots))
    digest = cut(first.where("extra IS NOT NULL").select("extra").mapInArrow(
        _digest_task, "doc_id long, n long, fp1 long, fp2 long"))
    sets = cut(digest.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    copies = digest.where("doc_id IS NOT NULL").join(
        sets.where("copies > 1").select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    shared = first.where("key IS NOT NULL").select(F.col("key").alias("fp1"), "pos", "places")
    enough = F.col("places") >= F.ceil(F.col("n") * percent / 100)
    may = cut(sets.select("fp1", "n", F.col("rep").alias("__rep")).join(shared, "fp1").where(enough).drop("n", "places"))
    texts = may_have(d, "doc_id", may, "__rep")
    texts = texts.join(may, texts["doc_id"] == may["__rep"]).select("doc_id", "fp1", "__text", "pos")
    # repeated rows of a representative are one member
    members = cut(texts.mapInArrow(_member_task(words), MEMBER).dropDuplicates(["doc_id", "fp1"]))

    classes = spark.sparkContext.broadcast(token_classes(members))
    sent = members.select("fp1", "n", "tokens").mapInArrow(
        _postings_task(percent, orders, slots, classes),
        "slot int, tokens binary, docs binary, left binary, right binary")
    links = sent.repartition("slot").sortWithinPartitions("slot").mapInArrow(
        _links_task(slots), "order int, a long, b long")
    found = components(links, by="order")
    nodes = found.select("order", "node", "root").unionByName(
        found.select("order", F.col("root").alias("node"), "root").distinct())
    cls = nodes.groupBy("node").agg(*(F.max(F.when(F.col("order") == k, F.col("root"))).alias(f"r{k}")
                                      for k in range(orders)))
    cls = cls.dropna().select(F.col("node").alias("fp1"), F.xxhash64(*(f"r{k}" for k in range(orders))).alias("cls"))
    blocks = cut(_blocks(cut(members.select("doc_id", "fp1", "n").join(cls, "fp1")), percent))

    similar = members.join(blocks, ["doc_id", "fp1"]).repartition("cls", "pair").sortWithinPartitions("cls", "pair").select(
        "cls", "pair", "doc_id", "n", "tokens").mapInArrow(_verify_task(percent), "a long, b long")
    comp = components(similar.unionByName(copies))
    return digest.join(comp, digest["doc_id"] == comp["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


@passes_columns
def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without near copies: of each class the one with the
    smallest id stays.  Of rows with that id one stays (the first by text);
    rows with a null id and texts without words stay all."""
    classes = cut(near_classes(docs, doc_id=doc_id, text=text, **how))
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    twice = classes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    gone = cut(gone.withColumn("__all", F.lit(True)).unionByName(
        twice.select(F.col("doc_id").alias("__gone"), F.lit(False).alias("__all"))))
    inside, outside = sieve(docs, doc_id, gone, "__gone")
    kept = inside.join(gone.where("__all"), F.col(doc_id) == F.col("__gone"), "left_anti")
    many = gone.where("NOT __all").select("__gone")
    blank = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE)) == ""
    first = Window.partitionBy("__gone").orderBy("__blank", F.col(text))
    ones = kept.withColumn("__blank", blank).join(many, F.col(doc_id) == F.col("__gone"))
    ones = ones.withColumn("__nth", F.row_number().over(first)).where("__nth = 1 OR __blank")
    kept = kept.join(many, F.col(doc_id) == F.col("__gone"), "left_anti").unionByName(
        ones.drop("__nth", "__blank", "__gone"))
    return outside.unionByName(kept)
