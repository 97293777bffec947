"""The corpus pipeline, stage by stage, against plain versions."""

import collections

import corpus_pipeline
from barsmith.llm import queries
from tests.llm import brute
from tests.llm.test_llm import ITEMS, PAD, docs, sample_texts


def corpus(spark, folder):
    line = "This line is shared by many of the documents here, over and over."
    rows = [(i * 2, t + ("\n" + line if i % 5 == 0 else ""), "en", f"s{i % 4}") for i, t in enumerate(sample_texts())]
    rows += [(901, None, "en", "a"), (902, "", "en", "a"), (903, "12 34 !!", "en", "b"), (904, PAD + " " + ITEMS[1][1], "en", None),
             (905, "a clean text that nobody else has, in a source of its own", None, None), (906, line, "en", "s1"),
             (907, line + "\n" + line + "\n" + line.upper() + "  ", "en", "s1")]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_every_stage_against_its_plain_version(spark, tmp_path):
    folder = corpus(spark, tmp_path)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "mix_sources"]
    stage = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(d)

    def step(name):
        nonlocal d
        stage[name](spark, d, folder).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        return d

    step("language_id")
    assert d.columns == corpus_pipeline.COLUMNS
    after = rows_of(d)
    letters = [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
    assert [r[:2] for r in after] == [r[:2] for r in letters] and all(r[2] for r in after)

    step("line_dedup")
    kept = {r[0]: r for r in brute.lines([(r[0], r[1]) for r in after])}
    import hashlib
    got = rows_of(d)
    assert len(got) == len(after)
    for r in got:
        assert hashlib.sha256(r[1].encode()).hexdigest() == kept[r[0]][3] and r[4] == len(r[1])
    assert sum(k[2] for k in kept.values()) > 5

    step("near_duplicates")
    classes = brute.classes([r[:2] for r in got], 5, 80)
    expect = {c if n else r[0] for r, (n, c) in zip(got, classes)}
    assert {r[0] for r in rows_of(d)} == expect and d.count() == len(expect) < len(got)

    step("decontaminate")
    assert expect - {r[0] for r in rows_of(d)} == {904}

    before_mix = {r[0]: r for r in rows_of(d)}
    out = stage["mix_sources"](spark, d, folder).collect()
    size, taken = collections.Counter(), collections.Counter()
    for r in before_mix.values():
        size[r[3]] += brute.words(r[1])
    for r in out:
        assert before_mix[r.doc_id] == tuple(r[c] for c in corpus_pipeline.COLUMNS) and 1 <= r.copies <= 2
        taken[r.source] += r.copies * brute.words(r.text)
    assert all(taken[s] <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 100 * len(size)


def test_run_applies_the_stages_and_entry_registers_everything(spark, tmp_path):
    import __spark_entry__ as entry
    out = corpus_pipeline.run(spark, corpus(spark, tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "copies"] and out.count() > 20
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_language_stage_rejects_by_score_and_keeps_all_without_labels(spark):
    import random
    from pyspark.sql import functions as F
    from tests.llm.test_llm import language_rows
    rnd = random.Random(5)
    clean = [(i, (t + " ") * 3, la, "s") for i, t, la, _ in language_rows()]
    junk = [(1000 + i, " ".join("".join(rnd.choices("qxzjkvwyþæ", k=6)) for _ in range(150)), None, "s") for i in range(5)]
    other = [(2000 + i, " ".join(rnd.choices("это не на что как мы они был для уже только".split(), k=250)), None, "s") for i in range(5)]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    got = {r.doc_id for r in stage(spark, docs(spark, clean + junk + other), "").collect()}
    assert got == {r[0] for r in clean}
    bare = docs(spark, [*clean[:20], (900, "12 !", "en", "s"), (901, None, "en", "s")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in stage(spark, bare, "").collect()} == {r[0] for r in clean[:20]}
