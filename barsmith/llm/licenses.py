"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into tokens; of every window of consecutive token k-grams the
smallest hash is a fingerprint, so any run of ``WINDOW + GRAM - 1`` template
tokens holds one.  An inverted index from fingerprint to template places is
looked up with the k-grams of every document.  Hits that lie together propose a
template and a diagonal, and a local alignment in a band around it reports the
matched share of the template and the span in the document, so notices with
changed, missing or added words are found too.  Alignments of one template that
follow one another are chained, so parts may be inserted or left out.

The scan is a map over documents; nothing is shuffled.  The index is built from
the templates, which are a parameter.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.shingles import WordHashes, windows, word_array

GRAM, WINDOW, BAND = 3, 2, 8
TOKEN = re.compile(r"[a-z0-9]+")

#: Wordings of common licenses and notices (the operative text of
#: short licenses, the standard notice of long ones).
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software""",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of every window (the last of equals)."""
    if len(h) <= window:
        return np.array([int(np.argmin(h))]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def build_index(templates: dict[str, str]) -> dict:
    cache, names, tokens, prints, places = WordHashes(), [], [], [], []
    for t, (name, text) in enumerate(sorted(templates.items())):
        words = [w.encode() for w in TOKEN.findall(text.lower())]
        h = word_array(words, cache)
        grams = windows(h, GRAM)
        at = winnow(grams)
        names.append(name)
        tokens.append(h)
        prints.append(grams[at])
        places.extend((t, int(p)) for p in at)
    prints, places = np.concatenate(prints), np.array(places, np.int64)
    by = np.argsort(prints, kind="stable")
    return {"names": names, "tokens": tokens, "prints": prints[by], "places": places[by]}


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int, int, int, int]:
    """Best local alignment with document place minus template place within
    ``band`` of ``shift``: ``(matches, start, end, score, first, last)``, start
    and end in ``doc``, first and last (exclusive) in the template.  A match
    scores 2, a mismatch or gap costs 1."""
    width = 2 * band + 1
    score, match, start, first = (np.zeros(width + 2, np.int64) for _ in range(4))
    best = (0, 0, 0, 0, 0, 0)
    for i, token in enumerate(template):
        j = i + shift - band + np.arange(width)
        inside = (j >= 0) & (j < len(doc))
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside]] == token
        # diagonal keeps its column; a skipped template token comes from the right
        diag, up = score[1:-1] + np.where(same, 2, -1), score[2:] - 1
        fresh = score[1:-1] <= 0
        new = np.maximum(np.maximum(diag, up), 0)
        take = diag >= up
        m = np.where(take, match[1:-1] + same, match[2:])
        s = np.where(take, np.where(fresh, j, start[1:-1]), start[2:])
        f = np.where(take, np.where(fresh, i, first[1:-1]), first[2:])
        for c in range(1, width):            # skipped document tokens, left to right
            if new[c - 1] - 1 > new[c]:
                new[c], m[c], s[c], f[c] = new[c - 1] - 1, m[c - 1], s[c - 1], f[c - 1]
        new[~inside] = 0
        m[new == 0] = 0
        score[1:-1], match[1:-1], start[1:-1], first[1:-1] = new, m, s, f
        c = int(np.argmax(new))
        if new[c] > best[3]:
            best = (int(m[c]), int(s[c]), int(j[c]) + 1, int(new[c]), int(f[c]), i + 1)
    return best


def pieces(template: np.ndarray, doc: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple]:
    """Alignments of a template that do not overlap, by place, until no hit
    ``(shift, place)`` is left: ``(start, end, matches, first, last)``.  The best
    one stays; the hits of a band that are outside of what was found are aligned
    again in the free part of the document around them."""
    ends, taken, queue = [], [], []

    def propose(hits: list[tuple[int, int]]) -> None:
        free = {}
        for shift, p in sorted(hits):
            k = bisect.bisect_right(ends, p)
            lo, hi = ends[k - 1] if k else 0, taken[k][0] if k < len(taken) else len(doc)
            if p + min(GRAM, len(template)) > hi:
                continue                     # covered
            if (lo, hi) not in free or shift - free[lo, hi][-1][0] > BAND:
                free.setdefault((lo, hi), []).append((shift, []))
            free[lo, hi][-1][1].append((shift, p))
        for (lo, hi), bands in free.items():
            for shift, own in bands:
                # only what the band can reach
                a, z = max(lo, shift - BAND), min(hi, shift + len(template) + BAND)
                m, s, e, score, f, t = align(template, doc[a:z], shift - a)
                if m >= min(GRAM, len(template)):
                    heapq.heappush(queue, (-score, s + a, e + a, m, f, t, own))

    propose(pairs)
    while queue:
        _, s, e, m, f, t, own = heapq.heappop(queue)
        k = bisect.bisect_right(ends, s)
        if k == len(taken) or taken[k][0] >= e:
            ends.insert(k, e)
            taken.insert(k, (s, e, m, f, t))
        propose(own)
    return taken


def chains(found: list[tuple], size: int, least: float) -> list[tuple[int, list[tuple]]]:
    """``(matches, pieces)`` of at least ``least`` matches: pieces that follow
    one another in the document and in the template, at most the template's
    length apart."""
    out = []
    while found:
        best, back = [p[2] for p in found], [None] * len(found)
        for i, (s, _, m, f, t) in enumerate(found):
            for j in range(i - 1, -1, -1):
                if s - found[j][1] > size:
                    break
                over = max(0, found[j][4] - f)
                if over <= min(BAND, m - 1, t - f - 1) and found[j][3] < f and best[j] + m - over > best[i]:
                    best[i], back[i] = best[j] + m - over, j
        used, cut_short, before = set(), False, len(out)
        for i in sorted(range(len(found)), key=lambda i: (-best[i], i)):
            if best[i] < least:
                break
            chain, at = [], i
            while at is not None and at not in used:
                chain.append(at)
                at = back[at]
            if at is not None:
                cut_short |= bool(chain)     # another took the rest: again among what is left
                continue
            used.update(chain)
            out.append((best[i], [found[k] for k in reversed(chain)]))
        if not cut_short or len(out) == before:
            break
        found = [p for k, p in enumerate(found) if k not in used]
    return out


def scan_text(text: str | None, index: dict, cache: WordHashes, need: float) -> list[tuple]:
    """``(license, coverage, start, end)`` in characters, by place; of matches
    that overlap, the one with more matched tokens stays."""
    low = text.lower() if text else ""
    if text and len(low) != len(text):       # a few letters change length: keep places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words = TOKEN.findall(low)
    if not words:
        return []
    h = word_array([w.encode() for w in words], cache)
    grams = windows(h, GRAM)
    lo, hi = np.searchsorted(index["prints"], grams), np.searchsorted(index["prints"], grams, side="right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return []
    hits = {}
    for p in at.tolist():
        for t, place in index["places"][lo[p]:hi[p]].tolist():
            hits.setdefault(t, []).append((p - place, p))
    found = []
    for t, pairs in hits.items():
        size = len(index["tokens"][t])
        for matches, parts in chains(pieces(index["tokens"][t], h, pairs), size, max(GRAM, need * size)):
            found.append((matches, matches / size, parts[0][0], parts[-1][1], index["names"][t], parts))
    if not found:
        return []
    spans = [m.span() for m in TOKEN.finditer(low)]
    kept, ends, taken = [], [], []           # what is taken, by place
    for matches, share, start, end, name, parts in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        places = [bisect.bisect_right(ends, s) for s, *_ in parts]
        if all(k == len(taken) or taken[k] >= e for k, (_, e, *_) in zip(places, parts)):
            for s, e, *_ in parts:
                k = bisect.bisect_right(ends, s)
                ends.insert(k, e)
                taken.insert(k, s)
            kept.append((start, end, name, share))
    return [(name, share, spans[start][0], spans[end - 1][1]) for start, end, name, share in sorted(kept)]


KIND = "array<struct<license:string,coverage:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None,
                  need: float = 0.7) -> DataFrame:
    """Adds ``licenses``: the license texts of each document with the matched
    share of the template (at least ``need``) and the span in characters.

    Null and empty texts have none.  Every occurrence in a text is reported;
    repeated rows are scanned alike.  ``licenses`` is replaced if there, other
    columns are passed on."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(templates or TEMPLATES))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, cache = shared.value, WordHashes()
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()),
                                   ("end", pa.int32())]))
        for batch in texts:
            yield pa.array([[dict(zip(("license", "coverage", "start", "end"), x))
                             for x in scan_text(t.as_py(), index, cache, need)] for t in batch], kind)
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("licenses", F.arrow_udf(run, KIND)(F.col(text)))
