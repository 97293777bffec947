"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(rows, n, percent):
    """[(n_shingles, component)] in the order of the rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    group = {i: i for i in range(len(rows))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = a and b and 100 * len(a & b) >= percent * len(a | b)
            if None not in (rows[i][0], rows[j][0]) and (linked or rows[i][0] == rows[j][0]):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(len(sets[i]), None if d is None else low[root(i)]) for i, (d, _) in enumerate(rows)]


def repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data):
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(SPACE).translate(UPPER)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = collections.defaultdict(list)
    for d, ls in split:
        for k in {key(x) for x in ls}:
            if len(k) >= min_chars:
                holders[k].append(d)
    rank = lambda d: (d is not None, d)
    top = {k: max(ds, key=rank) for k, ds in holders.items() if len(ds) >= min_docs}
    out = []
    for d, ls in split:
        kept = [x for x in ls if key(x) not in top or top[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def top_products(rows, every, k, scale=64):
    import math
    vecs = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in vecs:
        if q is None or q % every:
            continue
        found = [(-sum(x * y for x, y in zip(a, b)), c is None, c) for c, b in vecs if c != q]
        found.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(q, r + 1, c, -s) for r, (s, _, c) in enumerate(found[:k])]
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[.!?\n]|[%$€£]")


def template(text, names, units):
    """[(literal or kind, value or None)]"""
    out, before = [], "end"
    for t in TOKEN.findall(text or ""):
        low, kind = t.lower(), "word"
        if t in ".!?\n":
            kind = "end"
        elif t in "%$€£" or (low in units and before == "number"):
            kind = "unit"
        elif t[0].isdigit():
            kind = "number"
        elif t in names or (before != "end" and t[0].isupper() and t[1:].islower() and low not in units):
            kind = "name"
        if kind != "end":
            out.append((low, None) if kind == "word" else (kind, low))
        before = kind
    return out


def leaks(docs, items, names, units, width=8, literals=4, need=.5):
    """{(doc_id, smallest item_id with that template, matched, windows, reworded)}"""
    known = {}
    for i, text in sorted(items, key=lambda x: str(x)):
        t = tuple(template(text, names, units))
        if t and i is not None:
            known[t] = min(i, known.get(t, i))
    out = set()
    for doc, text in set(docs):
        d = template(text, names, units)
        for t, item in known.items():
            w = min(width, len(t))
            every = range(len(t) - w + 1)
            lit = [p for p in every if sum(v is None for _, v in t[p:p + w]) >= min(literals, w)]
            equal, fits = set(), set()
            for diag in range(-len(t), len(d)):
                here = [p for p in every if 0 <= p + diag and p + diag + w <= len(d)]
                equal |= {(diag, p) for p in here if [v or x for x, v in t[p:p + w]] == [v or x for x, v in d[p + diag:p + diag + w]]}
                same = [p for p in here if p in lit and [x for x, _ in t[p:p + w]] == [x for x, _ in d[p + diag:p + diag + w]]]
                slots = {q for p in same for q in range(p, p + w) if t[q][1] is not None}
                votes = collections.Counter((t[q][1], d[q + diag][1]) for q in slots)
                score = {(x, y): 2 * n + (x == y) for (x, y), n in votes.items()}
                best = {}
                for (x, y), n in score.items():
                    best.setdefault(x, []).append((n, y))
                stands = {}
                for x, v in best.items():
                    top = max(v)[0]
                    stands[x] = v[[n for n, _ in v].index(top)][1] if sum(n == top for n, _ in v) == 1 else None
                fits |= {(diag, p) for p in same if all(t[q][1] is None or stands[t[q][1]] == d[q + diag][1] for q in range(p, p + w))}
            fits |= {x for x in equal if x[1] in lit}
            matched, total = len({p for _, p in fits}), len(lit)
            shown = fits | equal
            if not total or matched < need * total:
                matched, total, shown = len({p for _, p in equal}), len(every), equal
            if matched and matched >= need * total:
                out.add((doc, item, matched, total, bool(shown - equal)))
    return out
