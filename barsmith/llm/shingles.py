"""Word shingles as 64-bit hashes, and streams of rows sorted by a key.

These run inside tasks, a document or a group at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: words kept per task so that a word is hashed once
CACHE_WORDS = 100_000


class WordHashes(dict):
    """Hash of a word (bytes); forgets everything when it holds too much."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased.  On bytes, ``lower`` touches ASCII
    only and ``split`` cuts at space and \\x09-\\x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; different salts give unrelated orders."""
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_array(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n word hashes; with fewer, of all of them."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + mixed(h[i:len(h) - n + 1 + i])
    return mixed(out, n)


def shingle_set(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(word_array(ascii_words(text), cache), n))


def grouped(batches, keys: list[str]):
    """Consecutive rows with equal keys as ``(key tuple, table)``, from record
    batches sorted by the keys.  Holds one group at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        vals = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in cols]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for v in vals:
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new).tolist() + [batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(v[a].item() if hasattr(v[a], "item") else v[a] for v in vals)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def binary(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All values of a column of packed arrays, one after the other."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def pack(x: np.ndarray) -> bytes:
    """Compressed array; the number of values follows."""
    return pa.compress(pa.py_buffer(np.ascontiguousarray(x)), codec="zstd", asbytes=True) + len(x).to_bytes(8, "little")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[-8:], "little")
    return np.frombuffer(pa.decompress(b[:-8], n * np.dtype(dtype).itemsize, codec="zstd"), dtype)
