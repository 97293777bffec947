"""Which of very many hashes occur twice: packed entries, sorted a block at a
time.

A task collects entries (hash, text key, position) and sends them as packed
arrays to the block of their hash, 6 to 10 bytes an entry.  All entries of a
hash meet in one block, but a task sends a hash once: entries that are equal
within the task are settled there and leave one marker, so a string that a
third of all texts share costs one entry a task.  There is one block per
shuffle partition, so a block sends at most as many packets as a shuffle has
files; a block's entries are sorted a slice of their hashes at a time.  Results
are ``(key, positions)``: where each text holds a string that also occurs
elsewhere; they are merged per text in buckets of its key.  Equal (key,
position) pairs are one entry, so copies of a text under one key do not tie with
each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.llm.shingles import binary, grouped, mixed, pack, unpack

#: entries held in a task, text keys it remembers
HELD = 1 << 19
SEEN = 1 << 20
#: entries of a block that are sorted at a time
SLICE = 1 << 18
MARK = np.uint32(0xFFFFFFFF)
SENT = ("slot int, hashes binary, keys binary, runs binary, pos binary, "
        "done_keys binary, done_runs binary, done_pos binary, extra binary")
NAMES = [c.split()[0] for c in SENT.split(", ")]
TIES = "key long, pos binary, places int, extra binary"


class Postings:
    """Entries of a task on their way to the blocks.  ``width`` bytes of a hash
    are compared within a block; ``note`` sends bytes along."""

    def __init__(self, slots: int, width: int):
        self.slots, self.width, self.parts, self.size, self.notes = slots, width, [], 0, {}
        self.noted = self.waiting = 0
        self.seen = set()

    def new(self, key: int) -> bool:
        """Whether this task has not met the text yet (it may forget)."""
        if key in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(key)
        return True

    def add(self, key: int, h: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((key, h, pos.astype(np.uint32)))
        self.size += len(h)

    def note(self, data: bytes) -> None:
        """To any block: notes go to all in turn, whatever they are about."""
        self.notes.setdefault(self.noted % self.slots, []).append(data)
        self.noted, self.waiting = self.noted + 1, self.waiting + 1

    def full(self) -> bool:
        return self.size >= HELD or self.waiting >= HELD

    def send(self):
        if not self.parts and not self.notes:
            return
        h = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.uint64)])
        key = np.repeat(np.array([p[0] for p in self.parts], np.int64),
                        np.array([len(p[1]) for p in self.parts], np.int64))
        pos = np.concatenate([p[2] for p in self.parts] or [np.zeros(0, np.uint32)])
        notes, self.parts, self.size, self.notes, self.waiting = self.notes, [], 0, {}, 0
        by = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        tied = np.zeros(len(h), bool)
        tied[by] = np.repeat(count > 1, count)
        done_key, done_pos = key[tied], pos[tied]
        keep = ~tied
        keep[by[start[count > 1]]] = True            # one marker for what is settled here
        pos, key = np.where(tied, MARK, pos), np.where(tied, 0, key)
        h, key, pos = h[keep], key[keep], pos[keep]
        slot, done_slot = (mixed(x, 5) % np.uint64(self.slots) for x in (h, done_key.view(np.uint64)))
        by, done_by = np.argsort(slot, kind="stable"), np.argsort(done_slot, kind="stable")
        every = np.arange(self.slots + 1, dtype=np.uint64)
        at, done_at = np.searchsorted(slot[by], every), np.searchsorted(done_slot[done_by], every)
        out = {name: [] for name in NAMES}
        for s in range(self.slots):
            mine, settled, extra = by[at[s]:at[s + 1]], done_by[done_at[s]:done_at[s + 1]], notes.get(s)
            if not (len(mine) or len(settled) or extra):
                continue
            out["slot"].append(s)
            out["extra"].append(b"".join(extra) if extra else None)
            low = h[mine].view(np.uint8).reshape(-1, 8)[:, :self.width]
            out["hashes"].append(np.ascontiguousarray(low).tobytes())
            for pre, k, p in (("", key[mine], pos[mine]), ("done_", done_key[settled], done_pos[settled])):
                edge = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                out[pre + "keys"].append(k[edge].tobytes())
                out[pre + "runs"].append(pack(np.diff(np.append(edge, len(k))).astype(np.uint32)))
                out[pre + "pos"].append(pack_places(p))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "slot" else pa.binary())
                                          for k, v in out.items()})


def pack_places(pos: np.ndarray) -> bytes:
    """Positions as compressed differences."""
    return pack(np.diff(pos, prepend=np.uint32(0)).astype(np.uint32))


def places(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint32), dtype=np.uint32)


def _entries(rows: pa.Table, pre: str = "") -> tuple[np.ndarray, np.ndarray]:
    runs = [unpack(r, np.uint32) for r in rows.column(pre + "runs").to_pylist()]
    pos = [places(p) for p in rows.column(pre + "pos").to_pylist()]
    keys = binary(rows.column(pre + "keys"), np.int64)
    return np.repeat(keys, np.concatenate(runs)) if runs else keys, np.concatenate(pos) if pos else np.zeros(0, np.uint32)


def _by_key(key: np.ndarray, pos: np.ndarray, slots: int, home: int, extra: list[bytes]) -> pa.RecordBatch:
    """Results packed by bucket of the text key, notes in the block's own."""
    bucket = mixed(key.view(np.uint64), 6) % np.uint64(slots)
    by = np.lexsort((pos, key, bucket))
    key, pos, bucket = key[by], pos[by], bucket[by]
    at = np.searchsorted(bucket, np.arange(slots + 1, dtype=np.uint64))
    out = {name: [] for name in ("slot", "keys", "runs", "pos", "extra")}
    for s in range(slots):
        i, j = at[s], at[s + 1]
        if j > i or (extra and s == home):
            k = key[i:j]
            edge = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            for name, v in (("slot", s), ("keys", k[edge].tobytes()), ("pos", pack_places(pos[i:j])),
                            ("runs", pack(np.diff(np.append(edge, len(k))).astype(np.uint32))),
                            ("extra", b"".join(extra) if s == home and extra else None)):
                out[name].append(v)
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "slot" else pa.binary()) for k, v in out.items()})


def _tied(raw: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some hashes with all their entries in a block: the entries whose
    string another entry has too."""
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :raw.shape[1]] = raw
    h = full.view(np.uint64).ravel()
    by = np.argsort(h, kind="stable")
    h = h[by]
    same = h[1:] == h[:-1]
    close = np.append(False, same) | np.append(same, False) if len(h) else np.zeros(0, bool)
    close |= pos[by] == MARK                         # the rest are single
    by, h = by[close], h[close]
    inner = np.lexsort((pos[by], key[by], h))
    h, key, pos = h[inner], key[by][inner], pos[by][inner]
    same = h[1:] == h[:-1]
    other = same & ((key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))
    mark = pos == MARK
    group = np.cumsum(np.append(True, ~same)) - 1 if len(h) else np.zeros(0, np.int64)
    multi = np.zeros(int(group[-1]) + 1 if len(h) else 0, bool)
    multi[group[1:][other]] = True
    multi[group[mark]] = True
    hit = multi[group] & ~mark
    return key[hit], pos[hit]


def _ties_task(width: int, slots: int):
    """One block: its ties, a slice of the hashes (by their first byte) at a
    time, and what the tasks had settled."""
    def run(batches):
        for (slot,), rows in grouped(batches, ["slot"]):
            raw = binary(rows.column("hashes"), np.uint8).reshape(-1, width)
            key, pos = _entries(rows)
            slices = min(1 + len(raw) // SLICE, 256)
            part = raw[:, 0] % slices if slices > 1 else np.zeros(len(raw), np.uint8)
            found = [_entries(rows, "done_")]
            for k in range(slices):
                mine = np.flatnonzero(part == k)
                found.append(_tied(raw[mine], key[mine], pos[mine]))
            yield _by_key(*(np.concatenate(x) for x in zip(*found)), slots, slot,
                          [x for x in rows.column("extra").to_pylist() if x])
    return run


def _merge_task(batches):
    """All positions of a key, from every block."""
    for _, rows in grouped(batches, ["slot"]):
        key, pos = _entries(rows)
        by = np.lexsort((pos, key))
        key, pos = key[by], pos[by]
        new = np.append(True, (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])) if len(key) else np.zeros(0, bool)
        key, pos = key[new], pos[new]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(key)) if len(edge) else edge
        if len(edge):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[edge]), pa.array([pack_places(pos[a:b]) for a, b in zip(edge, ends)], pa.binary()),
                 pa.array((ends - edge).astype(np.int32)), pa.nulls(len(edge), pa.binary())],
                names=["key", "pos", "places", "extra"])
        extra = [x for x in rows.column("extra").to_pylist() if x]
        if extra:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(extra), pa.int64()), pa.nulls(len(extra), pa.binary()),
                 pa.nulls(len(extra), pa.int32()), pa.array(extra, pa.binary())],
                names=["key", "pos", "places", "extra"])


def find_ties(sent: DataFrame, width: int, slots: int) -> DataFrame:
    """One row of ``TIES`` per text with ties, its positions sorted, and rows
    with the notes.  Results travel packed by text key, as entries did by hash."""
    found = sent.repartition("slot").sortWithinPartitions("slot").mapInArrow(
        _ties_task(width, slots), "slot int, keys binary, runs binary, pos binary, extra binary")
    return found.repartition("slot").sortWithinPartitions("slot").mapInArrow(_merge_task, TIES)
