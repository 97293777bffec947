"""Conversation trie and list ranking against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import listrank, turntrie
from tests.llm import brute

TURN = "conv_id long, turn long, role string, text string"


def brute_trie(rows, share=20, most=4):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, share))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = collections.defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) if children[n] else 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * brute.words(n[-1][1]) if n else 0)
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed=1, n=120):
    rnd = random.Random(seed)
    openings = [f"hello there {i}" for i in range(3)]
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue                                             # ids with gaps, groups without their first
        for t in range(rnd.randint(1, 7)):
            text = rnd.choice(openings) if t < 3 else f"turn {rnd.randint(0, 3)} of \t some words\n"
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t % 2 else "user", text))
    rows += [(500, None, None, None), (500, 1, "user", ""), (500, 1, "user", ""), (500, None, "user", "first"),
             (None, 1, "user", "nobody's"), (-7, 0, "user", "hello there 1"), (-7, 3, "user", "b"), (-7, 3, "user", "a"),
             (520, 0, "user", "only"), (521, 0, "user", "w " * 40000), (540, -5, "", "x"), (540, 2, None, "y")]
    rows += [(c, t, "user", f"same {t}") for c in range(600, 700) for t in range(4)]       # a common conversation
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,held,turns,ids,positions", [
    (listrank.BLOCK, listrank.HELD, turntrie.TURNS, turntrie.IDS, turntrie.POSITIONS), (16, 20, 2, 7, 50)])
def test_trie_matches_brute(spark, monkeypatch, block, held, turns, ids, positions):
    monkeypatch.setattr(turntrie, "TURNS", turns)
    monkeypatch.setattr(turntrie, "IDS", ids)
    monkeypatch.setattr(turntrie, "POSITIONS", positions)
    rows = conversations()
    df = spark.createDataFrame(rows, TURN).repartition(5)
    got = nodes(turntrie.conversation_trie(df, block=block, held=held))
    assert got == brute_trie(rows)


def test_trie_other_columns_empty_table_and_plain_conversations(spark):
    rows = conversations(2, 40)
    df = spark.createDataFrame(rows, TURN).withColumns({c: F.lit("own") for c in (
        "conv", "pos", "depth", "number", "block", "id", "next", "first", "words", "arc", "chunk", "last", "total", "__part")})
    assert nodes(turntrie.conversation_trie(df, most=1)) == brute_trie(rows, most=1)
    none = turntrie.conversation_trie(df.limit(0))
    assert none.count() == 0 and none.columns == COLUMNS
    assert turntrie.conversation_trie(df.where("conv_id IS NULL")).count() == 0


def test_trie_of_turnless_conversations(spark):
    # conversations whose first turns are taken from one that is not there
    rows = [(c, 0, "user", "x") for c in range(1, 20)]
    got = nodes(turntrie.conversation_trie(spark.createDataFrame(rows, TURN)))
    assert got == brute_trie(rows) and any(r[1] == 0 and r[3] == 19 for r in got)


def test_a_deep_conversation_is_split_and_ranked(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "TURNS", 100)
    rows = [(20, t, "user", f"w{t % 3}") for t in range(3000)] + [(40, t, "user", f"w{t % 3}") for t in range(2000)]
    assert nodes(turntrie.conversation_trie(spark.createDataFrame(rows, TURN), block=256, held=64)) == brute_trie(rows)


@pytest.mark.parametrize("n,block,held", [(10_000, 64, 100), (10_000, 1 << 16, 1 << 18), (1, 4, 4), (0, 4, 4)])
def test_list_ranks(spark, n, block, held):
    order = np.random.default_rng(5).permutation(n)
    follow = np.append(order[1:], -1)[:n]
    links = spark.createDataFrame([(int(a), None if b < 0 else int(b)) for a, b in zip(order, follow)], "id long, next long")
    got = {r["id"]: r["to_end"] for r in listrank.rank_list(links, block, held).collect()}
    assert got == {int(a): n - i for i, a in enumerate(order)}
