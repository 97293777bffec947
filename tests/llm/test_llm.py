"""The training-data operators against plain versions, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barsmith.llm import (graph, jaccard, langid, licenses, lines, mixing, postings, repeats, reputation, revisits, templates,
                          topk)
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use within, with values that must come through
CLASH = ("key", "slot", "n", "hash", "pos", "block", "part", "node", "root", "pair", "cls", "item_id")


def own(df, **more):
    return df.withColumns({**{c: F.lit("own") for c in CLASH}, **more})


def docs(spark, rows):
    rows = [(r + (None,) * 4)[:4] for r in rows]
    return spark.createDataFrame([(d, t, la, s, len(t or "")) for d, t, la, s in rows], DOC).repartition(3)


def sample_texts(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    sentence = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    out = [sentence(rnd.randint(5, 120)) for _ in range(n)]
    for i in range(0, n, 4):                     # near copies and shared passages
        w = out[i].split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(sentence(20) + " " + out[1] + " " + sentence(20))
    return out + ["Short", "two words", "two  WORDS\t", "a b c", " \n\t", "É É É é"]


def edge_rows(spark):
    texts = sample_texts()
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (None, texts[0]), (None, "unlike all others here"), (7, texts[2]), (7, texts[2]),
             (2000, " ".join(texts) * 6), (2001, "x" * 5000), (2002, "line\n" * 300)]
    return rows


def counted(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# -- 1 mixing ----------------------------------------------------------------

def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(0, 300), None, rnd.choice(["a", "b", "b", "b", "B", None])) for i in range(3000)]
    rows += [(5000, None, None, "a"), (5001, "", None, "only"), (5002, "one", None, "z"), (5002, "one", None, "z")]
    d = docs(spark, rows)
    out = [r.asDict() for r in mixing.mix_report(d).collect()]
    assert sorted(str(r) for r in out) == sorted(str(r.asDict()) for r in mixing.mix_report(d.repartition(7)).collect())
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == brute.words(next(x[1] for x in rows if x[0] == r["doc_id"]))
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, goal, expect = set(names), 1.5 * sum(size.values()), {}
    while True:                                  # shares, excess reshared
        level = goal / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            expect[s] = 2.0 * size[s]
            goal -= expect[s]
            left.discard(s)
    expect.update({s: level * weight[s] for s in left})
    for s in names:
        assert target[s] == pytest.approx(expect[s])
        assert abs(taken[s] - target[s]) <= 160          # half the longest text


def test_mix_passes_columns_and_takes_empty_tables(spark):
    d = own(docs(spark, [(i, "a b c", "en", "s") for i in range(50)]), copies=F.lit("old"))
    out = mixing.mix(d, share=0.5)
    assert set(out.columns) == set(d.columns) and dict(out.dtypes)["copies"] == "bigint"
    assert abs(out.agg(F.sum("copies")).first()[0] - 25) <= 1
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix_report(d.limit(0)).count() == 0


def test_pareto_inclusion_follows_odds():
    # of many draws with probabilities .2 and .8 the shares come out near them
    u = np.random.default_rng(0).random((4000, 20))
    pi = np.array([.2] * 10 + [.8] * 10)
    q = (u / (1 - u)) * ((1 - pi) / pi)
    share = (np.argsort(np.argsort(q, axis=1), axis=1) < 10).mean(axis=0)
    assert abs(share[:10].mean() - .2) < .02 and abs(share[10:].mean() - .8) < .02


# -- 2 lines -----------------------------------------------------------------

def line_rows():
    rnd = random.Random(5)
    common = [f"A common LINE number {i} that is quite long enough é" for i in range(6)]
    rows = []
    for i in range(60):
        ls = [f"own line {i} {j} " + "z" * rnd.randint(0, 60) for j in range(rnd.randint(0, 4))]
        ls += rnd.sample(common, rnd.randint(0, 4)) + ["short", "", " \t" + common[0].upper().replace("É", "é") + "\x0b"] * (i % 3 == 0)
        rnd.shuffle(ls)
        rows.append((i * 2, "\n".join(ls)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (7, "\n".join(common)), (7, "\n".join(common)), (None, common[1])]
    return rows + [(503, "\n".join(common * 40) + "\n" + "q" * 9000)]


@pytest.mark.parametrize("batches,fan_in", [(4, 3), (6, 2), (1, 3)])
def test_lines_match_brute(spark, batches, fan_in):
    rows = line_rows()
    got = counted(lines.digest_lines(docs(spark, rows), batches=batches, fan_in=fan_in),
                  "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == collections.Counter(brute.lines(rows))


def test_lines_columns_and_empty(spark):
    d = own(docs(spark, line_rows()), kept=F.lit(1))
    out = lines.dedup_lines(d)
    assert set(out.columns) == set(d.columns) | {"n_lines", "n_dropped"} and out.where("key = 'own'").count() == d.count()
    assert lines.dedup_lines(d.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables("barsmith_scratch") if "line" in t.name]


def test_lines_count_documents_and_not_rows(spark):
    line = "A line of forty characters or more that two documents share."
    out = lines.dedup_lines(docs(spark, [(1, line)] * 4 + [(2, line)])).collect()
    assert len(out) == 5 and {r.n_dropped for r in out} == {0}
    out = lines.dedup_lines(docs(spark, [(1, line)] * 4 + [(i, line) for i in range(2, 6)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in out) == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]


# -- 3 language ----------------------------------------------------------------

def language_rows():
    rnd = random.Random(2)
    words = {"en": "the of and to that with this from have were which".split(),
             "de": "der die und das nicht mit für über schön größe straße".split(),
             "fr": "le la les des pour avec être où français était à".split()}
    return [(i, " ".join(rnd.choices(words[la], k=rnd.randint(6, 60))), la, "s")
            for i, la in enumerate(rnd.choices(sorted(words), k=400))]


def test_language_held_out_accuracy_and_edges(spark):
    rows = language_rows() + [(900, None, "en"), (901, "", "en"), (902, "123 !? \n", "de"), (903, "the and", None),
                              (None, "der die das und", "de"), (904, "the of and " * 4000, "en"), (1, "the of", "en")]
    d = own(docs(spark, rows), score=F.lit("old"))
    out = langid.identify(d)
    assert set(out.columns) == set(d.columns) | {"held_out", "lang_pred"} and out.count() == len(rows)
    got = out.collect()
    import zlib
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.key == "own"
    held = [r for r in got if r.held_out and r.lang and r.text and any(c.isalpha() for c in r.text)]
    assert sum(r.lang == r.lang_pred for r in held) >= .98 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 903] == ["en"]


def test_language_without_labels_or_rows(spark):
    d = docs(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in langid.identify(d).collect()} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    v, table = langid.Vectors(64), langid.symbol_table()
    t = langid.trigrams("ab, ba", table)
    a, b = table[ord("a")], table[ord("b")]
    one = lambda x, y, z: v.a[x].astype(int) * v.b[y] * v.c[z]
    expect = one(0, a, b) + one(a, b, 0) + one(0, b, a) + one(b, a, 0)
    assert (v.bundle(t) == expect).all()


# -- 4 top k ---------------------------------------------------------------------

def test_top_products_match_brute(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1 if j < 4 else .2) for j in range(12)]) for i in range(260)]
    rows += [(300, [rnd.gauss(0, 3) for _ in range(12)]), (301, None), (302, [1.0, None]), (303, [float("nan")] * 12),
             (304, [float("inf")] + [0.0] * 11), (305, []), (306, [1.0, 2.0]), (None, [.5] * 12), (320, [0.0] * 12),
             (340, [.25] * 12), (341, [.25] * 12), (342, [.25] * 12), (342, [.25] * 12), (360, [1e9] * 12)]
    rows += [(400 + i, [.25] * 12) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "block": F.lit(2)})
    got = counted(topk.top_products(d, F.col("vec_id") % 20 == 0, k=7), "query_id", "rank", "vec_id", "score")
    assert got == collections.Counter(brute.top_products(rows, 20, 7))
    assert topk.top_products(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_prunes_without_loss():
    rnd = np.random.default_rng(1)
    x = np.rint(rnd.normal(0, 20, (5000, 32)) * np.geomspace(3, .1, 32) * rnd.gamma(2, 1, (5000, 1))).astype(np.int64)
    q = x[:50]
    basis = np.linalg.svd(x.astype(float), full_matrices=False)[2].T
    best = topk.search(np.arange(50), q, np.full(50, -np.inf), np.arange(5000), x, basis, 5)
    for i in range(50):
        s = sorted((-int(v), j) for j, v in enumerate(x @ q[i]) if j != i)[:5]
        mine = best.q == i
        assert [(-int(a), int(b)) for a, b in zip(best.score[mine], best.id[mine])] == s


# -- 5 hosts ----------------------------------------------------------------------

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_rules_and_hosts(spark):
    urls = {1: "http://WWW.Example.com/en/1", 2: "https://a.example.com/en/x?q=/en/", 3: "http://x.com/", 4: "http://x.com",
            5: "ftp://b.net/es/1#t", 6: "http://b.net/fr/1", 7: None, 8: "no scheme", 9: "", 10: "x://y://z.com/p",
            11: "http://notexample.com/en/", 12: "http://bad.org/1", 13: "http://É.COM/Ä"}
    pages = spark.createDataFrame(list(urls.items()) + [(6, urls[6])], "page_id long, url string")
    pages = pages.withColumns({"n": F.lit("own"), "bad": F.lit("own"), "rules": F.lit("own"), "verdict": F.lit("old")})
    labels = [("http://bad.org/%d" % i, True) for i in range(60)] + [("http://b.net/%d" % i, False) for i in range(60)]
    labels += [("http://x%d.org/" % i, i % 9 == 0) for i in range(200)] + [(None, True), ("http://b.net/", None)]
    out = reputation.judge(pages, spark.createDataFrame(labels, "url string, bad boolean"), RULES)
    rows = out.collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 14 and {r.n for r in rows} == {"own"}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("x.com", "/", "com/", "allow") and got[4][:3] == ("x.com", "", None)
    assert got[5] == ("b.net", "/es/1", "net/es/", "block") and got[6] == ("b.net", "/fr/1", None, "allow")
    assert [got[i][:3] for i in (7, 8, 9)] == [("", "", None)] * 3
    assert got[10] == ("y:", "//z.com/p", None, "allow") and got[11][2] == "com/"
    assert got[12][3] == "block" and got[13][:2] == ("É.com", "/Ä")
    none = reputation.judge(pages, out.limit(0).select("url", F.lit(True).alias("bad")), [])
    assert {r.verdict for r in none.collect()} <= {"allow", "block"}
    assert reputation.judge(pages.limit(0), out.limit(0).select("url", F.lit(True).alias("bad")), RULES).count() == 0


def test_posterior_shrinks_to_domain(spark):
    hosts = [("a.good.org", 400, 8), ("b.good.org", 2, 1), ("a.bad.org", 400, 380), ("b.bad.org", 2, 1), ("c.bad.org", 0, 0)]
    out = reputation.reputation(spark.createDataFrame(hosts, "host string, n long, bad long"), 1.645)
    m = {r.host: r for r in out.collect()}
    assert m["b.good.org"].bad_mean < m["b.bad.org"].bad_mean
    assert abs(m["a.bad.org"].bad_mean - .95) < .02 and all(r.bad_low < r.bad_mean for r in m.values())


# -- 6 revisits --------------------------------------------------------------------

CAPTURE = ("record_id long, url string, ts long, kind string, etag string, last_modified string, "
           "headers map<string,string>, payload_digest string, payload_length int")


def test_revisits_resolve_to_latest_earlier_response(spark):
    h = {"content-type": "text/html", "expires": "1"}
    rows = [(1, "http://www.A.com/x/", 10, "response", '"e1"', None, h, "d1", 5),
            (2, "https://a.com/x#f", 20, "revisit", 'W/"e1"', None, {"expires": "2", "content-type": "no"}, None, None),
            (3, "http://a.com/x", 20, "response", None, "mon", None, "d3", 6),
            (4, "http://a.com/x", 20, "revisit", '"e1"', None, None, None, None),
            (5, "http://a.com/x?utm_source=q", 30, "revisit", None, "mon", None, None, None),
            (6, "http://a.com/x", 31, "revisit", None, "tue", None, None, None),
            (7, "http://a.com/y", 5, "revisit", None, None, None, None, None),
            (8, None, 5, "revisit", None, None, None, None, None),
            (9, "http://a.com/x", None, "revisit", None, None, None, None, None),
            (10, "http://b.com", 1, "response", None, None, h, "d10", 1),
            (11, "http://b.com/", 2, "revisit", None, None, {"expires": "3"}, None, None),
            (11, "http://b.com/", 2, "revisit", None, None, {"expires": "3"}, None, None),
            (12, "http://b.com", 1, "response", None, None, h, "d12", 1), (13, "http://b.com", 3, "other", None, None, h, "d", 1)]
    d = spark.createDataFrame(rows, CAPTURE).withColumns({"pid": F.lit(1), "r": F.lit(2), "response": F.lit(3), "good": F.lit(4)})
    out = revisits.resolve_revisits(d)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.record_id].append((r.refers_to, r.resolution, r.payload_digest, r.headers))
    assert got[2] == [(1, "etag", "d1", {"content-type": "text/html", "expires": "2"})]
    assert got[4][0][:2] == (1, "etag") and got[5][0][:3] == (3, "modified", "d3")
    assert got[6][0][:2] == (None, "changed")
    assert {got[i][0][:2] for i in (7, 8, 9)} == {(None, "missing")}
    assert [g[:3] for g in got[11]] == [(12, "unvalidated", "d12")] * 2 and len(got) == 8
    assert revisits.resolve_revisits(d.limit(0)).count() == 0


def test_revisits_of_one_hot_url_span_partitions(spark):
    rows = [(i, "http://hot.com/", i, "response" if i % 97 == 0 else "revisit", str(i // 97), None, None, str(i), 1)
            for i in range(3000)]
    out = revisits.resolve_revisits(spark.createDataFrame(rows, CAPTURE).repartition(5))
    assert all(r.resolution == "etag" and r.refers_to == r.record_id // 97 * 97 for r in out.collect())


# -- 7 benchmark -------------------------------------------------------------------

ITEMS = [(1, "Tom has 3 apples and Anna has 12 apples. After 45 minutes Tom gives Anna 3 apples away from home."),
         (2, "The quick brown fox jumps over the lazy dog near the quiet river bank while nine people watch it."),
         (2, "Completely other text that has the same item id as the one before and is an item of its own too."),
         (3, None), (4, ""), (5, "too short"), (9, "The quick brown fox jumps over the lazy dog near the quiet river bank while nine people watch it.")]
PAD = "some words that come before or after a passage and have nothing to do with it at all"


def test_leaks_with_other_values_and_consistent_slots(spark):
    again = "Ben has 7 apples and Lucy has 30 apples. After 20 hours Ben gives Lucy 7 apples away from home."
    mixed = "Ben has 7 apples and Lucy has 30 apples. After 20 hours Paul gives Mary 8 apples away from home."
    rows = [(1, PAD + " " + ITEMS[0][1] + " " + PAD), (2, PAD + ". " + again + " " + PAD), (3, PAD + ". " + mixed + " " + PAD),
            (4, PAD), (5, None), (6, ""), (7, "x " * 30000 + ITEMS[1][1]), (8, ITEMS[1][1][:60]), (None, ITEMS[2][1]),
            (10, ITEMS[1][1].upper()), (11, ITEMS[1][1]), (11, ITEMS[1][1])]
    d = own(docs(spark, rows))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hash", F.lit("own"))
    got = {(r.doc_id, r.item_id, r.reworded) for r in templates.leaks(d, items).collect()}
    assert got == {(1, 1, False), (2, 1, True), (7, 2, False), (None, 2, False), (10, 2, False), (11, 2, False)}
    clean = templates.drop_leaks(d, items)
    assert set(clean.columns) == set(d.columns) and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 8]
    assert templates.leaks(d, items.limit(0)).count() == 0 and templates.drop_leaks(d.limit(0), items).count() == 0
    assert templates.drop_leaks(d, items.limit(0)).count() == len(rows)


def test_leaks_of_items_that_are_mostly_values(spark):
    items = [(1, "What is 12 + 30?"), (2, "Tom 12, Anna 30, Ben 45, Lucy 7, Mark 19, Nina 23, Paul 81")]
    rows = [(1, PAD + ". " + items[0][1]), (2, PAD + ". " + items[1][1] + ". " + PAD), (3, PAD + " What is 12 + 31?"),
            (4, PAD + ". Tom 13, Anna 31, Ben 46, Lucy 8, Mark 20, Nina 24, Paul 82"), (5, PAD)]
    found = templates.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.reworded) for r in found.collect()} == {(1, 1, False), (2, 2, False)}


def test_leaks_with_one_conflicting_slot_equal_values_or_other_case(spark):
    # windows without the slot in conflict count; two values may become one; case is no difference
    long = ("A farmer sells 48 melons at the market in the morning and then walks back to the old barn where the "
            "hired hands have loaded another cart with fruit so that by noon the total is again 48 melons in all.")
    items = [(1, long), (2, "We buy 3 apples and 5 pears today and then put all of them into the basket at home."),
             (3, "yesterday Tom met Anna and then Ben and Lucy with Mark and Nina and Paul and Sarah and Peter")]
    rows = [(1, PAD + ". " + long.replace("again 48", "again 50")), (2, items[1][1].replace("3", "4").replace("5", "4")),
            (3, items[2][1].lower()), (4, PAD + " " + items[2][1].upper()), (5, PAD)]
    found = templates.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}


# -- 8 licenses ----------------------------------------------------------------------

def test_licenses_spans_and_near_matches(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge, ", "").replace("merge,", "merge, fold,").replace("Software is", "Program is")
    rows = [(1, "Intro text. " + mit + " and more."), (2, "é İ " * 50 + changed + PAD), (3, PAD), (4, None), (5, ""),
            (6, "Released under the MIT License. " + PAD + " Licensed under CC BY-NC 4.0."), (7, (PAD + ' ') * 400 + mit),
            (8, mit[:150]), (6, "Released under the MIT License. ")]
    d = docs(spark, rows).withColumn("licenses", F.lit("old"))
    out = licenses.scan_licenses(d)
    assert out.columns == d.columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append([(x.license, round(x.coverage, 2), r.text[x.start:x.end][:10]) for x in r.licenses])
    assert got[1] == [[("MIT", 1.0, "Permission")]] and got[7] == got[1]
    assert got[2][0][0][0] == "MIT" and .9 < got[2][0][0][1] < 1 and got[2][0][0][2] == "Permission"
    assert got[3] == got[4] == got[5] == got[8] == [[]]
    assert sorted(map(len, got[6])) == [1, 2] and {x[0] for g in got[6] for x in g} == {"MIT-notice", "CC-BY-NC-4.0-notice"}
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_licenses_close_together_and_with_long_gaps(spark):
    bsd = licenses.TEMPLATES["BSD"].split()
    rows = [(1, "Copyright 2020 A. All rights reserved. Copyright 2021 B. All rights reserved."),
            (2, " ".join(bsd[:28] + ["inserted"] * 20 + bsd[28:])), (3, " ".join(bsd[:24] + bsd[36:])),
            (4, ("All rights reserved. " + PAD + ". ") * 3)]
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ["all-rights-reserved"] * 2, 2: ["BSD"], 3: ["BSD"], 4: ["all-rights-reserved"] * 3}


def test_winnowing_leaves_no_gap():
    h = np.random.default_rng(0).integers(0, 1 << 60, 500).astype(np.uint64)
    at = licenses.winnow(h, 5)
    assert max(np.diff(at)) <= 5 and at[0] < 5 and at[-1] >= 495


# -- 9 near copies ---------------------------------------------------------------------

@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_classes_match_brute(spark, words, percent):
    rows = edge_rows(spark)
    d = own(docs(spark, rows))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id)
                              for r in jaccard.near_classes(d, words=words, percent=percent).collect())
    assert got == collections.Counter((r[0], *b) for r, b in zip(rows, brute.classes(rows, words, percent)))


def test_large_classes_are_blocked_without_loss(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w[:rnd.choice([90, 90, 84, 60])])))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 32)
    got = {r.doc_id: r.component_id for r in jaccard.near_classes(docs(spark, rows), words=4, percent=85).collect()}
    assert got == {r[0]: b[1] for r, b in zip(rows, brute.classes(rows, 4, 85))}


def test_repeated_rows_of_an_id_are_one_member(spark, monkeypatch):
    seen, blocks = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda sets, percent: seen.append(sets.count()) or blocks(sets, percent))
    text = " ".join(f"w{i}" for i in range(60))
    out = jaccard.near_classes(docs(spark, [(1, text)] * 20 + [(2, text + " more"), (3, PAD)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1)] * 20 + [(2, 1), (3, 3)]
    assert seen == [2]


def test_one_of_each_class_stays(spark):
    rows = edge_rows(spark)
    out = jaccard.one_of_each(own(docs(spark, rows))).collect()
    assert len(out) < len(rows) and {r.key for r in out} == {"own"}
    ids = collections.Counter(r.doc_id for r in out)
    expect = collections.Counter({b[1] if b[0] else r[0] for r, b in zip(rows, brute.classes(rows, 5, 80)) if r[0] is not None})
    expect.update({None: 2})
    assert ids == expect
    assert jaccard.one_of_each(docs(spark, rows).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (7, 3)]
    df = graph.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in df.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# -- 10 repeats ------------------------------------------------------------------------

@pytest.mark.parametrize("length", [400, 60])
def test_repeats_match_brute(spark, length):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdeé ") for _ in range(500))
    noise = lambda k: "".join(rnd.choice("abcdefghij é") for _ in range(k))
    rows = [(i, noise(rnd.randint(0, 900))) for i in range(25)]
    rows += [(100 + i, noise(200) + passage[rnd.randint(0, 60):rnd.randint(380, 500)] + noise(150)) for i in range(12)]
    whole = noise(700)
    rows += [(200, whole), (201, whole), (202, whole), (202, whole), (203, None), (204, ""), (None, noise(600)),
             (205, "ab" * 600), (206, noise(400)), (207, noise(50) + "tail" * 100), (208, noise(399)), (208, noise(500)),
             (209, noise(3000) + passage + noise(3000) + passage)]
    got = counted(repeats.digest_repeats(own(docs(spark, rows)), length=length),
                  "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == collections.Counter(brute.repeats(rows, length))


def test_repeats_of_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    roll = repeats.Rolling(40)
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=1500)) * 2, np.uint8)
    h = np.concatenate([x for _, x in roll(data)])
    assert len(h) == len(data) - 39 and (h[:1461] == h[1500:]).all()
    assert repeats.digest_repeats(docs(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("r", range(5))
def test_difference_covers(r):
    v, cover = repeats.difference_cover(r)
    assert len(cover) == 6 * r + 4 and {(a - b) % v for a in cover for b in cover} == set(range(v))


# -- helper columns, graphs --------------------------------------------------

#: names of helper columns within the operators
HELPERS = ("__doc", "__drop", "__batch", "__docs", "__top", "__h1", "__gone", "__blank", "__all", "__nth", "__host", "__path",
           "__of", "__rules", "__low", "__fit", "__held", "__pred", "__key", "__leak", "__bucket", "__text", "__rep", "__id",
           "__src", "__size", "__q", "__copies", "own__doc", "__DROP2")


def test_columns_named_as_helpers_come_through(spark):
    rows = edge_rows(spark)[:40] + [(9000, "one two three four five"), (9001, "one two three four five")]
    d = docs(spark, [(i, t, "en", "s") for i, t in rows]).withColumns({c: F.lit(f"my {c}") for c in HELPERS})
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    pages = d.withColumn("url", F.concat(F.lit("http://a.b/"), "doc_id"))
    for out in (lines.dedup_lines(d, min_docs=2), jaccard.one_of_each(d), langid.identify(d, dim=256),
                langid.in_a_language(d, dim=256), templates.drop_leaks(d, items), mixing.mix(d),
                reputation.judge(pages, pages.select("url", F.lit(True).alias("bad")), [("allow", "a.b/")])):
        seen = out.select(*HELPERS).distinct().collect()
        assert [tuple(r) for r in seen] == [tuple(f"my {c}" for c in HELPERS)]


def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 64)
    order = random.Random(4).sample(range(10_000), 10_000)
    edges = list(zip(order, order[1:])) + [(20_000, 20_001 + i) for i in range(3000)] + [(50_000, 50_000)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(1, 10_000)}, **{20_001 + i: 20_000 for i in range(3000)}}


def test_exact_copies_and_empty_texts_go_to_all_blocks():
    from barsmith.llm import postings
    sent = postings.Postings(8, 4)
    for _ in range(800):
        sent.note(b"x")
    assert {len(v) for v in sent.notes.values()} == {100} and len(sent.notes) == 8


def test_a_text_of_a_large_alphabet_is_bundled_in_slabs(monkeypatch):
    codes = np.random.default_rng(2).integers(0, langid.SYMBOLS ** 3, 3000)
    want = langid.Vectors(64).bundle(codes)
    monkeypatch.setattr(langid, "VECTORS", 100)
    monkeypatch.setattr(langid, "SLAB", 64)
    small = langid.Vectors(64)
    assert (small.bundle(codes) == want).all() and len(small.rows) <= 1024
    assert (small.bundle(codes[:50]) == langid.Vectors(64).bundle(codes[:50])).all()


def test_blocks_send_no_more_packets_than_a_shuffle_has_files(spark, monkeypatch):
    slots = []
    monkeypatch.setattr(jaccard, "find_ties", lambda sent, width, n: slots.append(n) or postings.find_ties(sent, width, n))
    jaccard.near_classes(docs(spark, edge_rows(spark)), words=3).count()
    assert slots == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


@pytest.mark.parametrize("width", [4, 8])
def test_a_block_in_slices_has_the_same_ties(monkeypatch, width):
    rnd = np.random.default_rng(5)
    rows = []
    for task in range(3):
        out = postings.Postings(1, width)
        for key in range(40):
            h = rnd.integers(0, 3000, 50).astype(np.uint64)
            out.add(key + 100 * task if key else 0, h * np.uint64(0x9E3779B1), np.arange(50))
        rows += list(out.send())

    def ties():
        got = set()
        for batch in postings._ties_task(width, 1)(iter(rows)):
            key, pos = postings._entries(pa.Table.from_batches([batch]))
            got |= set(zip(key.tolist(), pos.tolist()))
        return got
    whole, sorted_at_once, tied = ties(), [], postings._tied
    monkeypatch.setattr(postings, "SLICE", 64)
    monkeypatch.setattr(postings, "_tied", lambda raw, *x: sorted_at_once.append(len(raw)) or tied(raw, *x))
    assert whole == ties() and whole
    assert len(sorted_at_once) > 10 and max(sorted_at_once) < 1000
