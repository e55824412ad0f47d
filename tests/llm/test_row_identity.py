"""What the pipeline's stages drop where ids repeat or are null."""

import numpy as np

import corpus_pipeline
from tripwise.llm import common, decontam, exact_dedup, minhash_forest, mixing, quality


def prose(seed, n):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_keeps_unique_texts_of_repeated_ids(make_docs):
    kept = [(3, "a"), (5, "unique"), (5, "unique"), (None, "only"), (None, None)]
    docs = make_docs([*kept, (5, "a"), (None, "a"), (8, "unique")])
    got = exact_dedup.drop_exact_copies(docs, capacity=2)
    assert left(got) == sorted(kept, key=str) and got.columns == docs.columns


def test_near_keeps_unique_texts_of_repeated_ids(make_docs):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    kept = [(3, a), (5, b), (5, b), (7, c), (None, "only words here"), (9, "")]
    docs = make_docs([*kept, (5, a + " more"), (8, b + " more"), (None, c + " more"), (None, "only words here")])
    got = minhash_forest.drop_near_copies(docs)
    assert left(got) == sorted([*kept, (None, "only words here")], key=str) and got.columns == docs.columns
    none = minhash_forest.drop_near_copies(make_docs([(None, a), (None, a + " more")]))
    assert none.count() == 1


def test_leaks_go_row_by_row(spark, make_docs):
    leak = prose(4, 25)
    kept = [(1, prose(6, 40)), (None, prose(8, 40)), (3, None), (None, None), (2, prose(7, 40))]
    docs = make_docs([*kept, (2, "x " + leak), (None, leak + " y")])
    items = spark.createDataFrame([("b", leak)], "item_id string, text string")
    got = decontam.drop_contaminated(docs, items)
    assert left(got) == sorted(kept, key=str) and got.columns == docs.columns


def test_no_text_is_lost_with_its_id(make_docs):
    docs = make_docs([(1, "a"), (7, "a"), (7, "unique text")])
    assert left(exact_dedup.drop_exact_copies(docs)) == [(1, "a"), (7, "unique text")]


def test_mix_keeps_each_rows_size(make_docs):
    rows = [(5, "w " * 10), (5, "v " * 3), (6, "u " * 4), (None, "t " * 6), (None, "t " * 6), (None, None), (8, " "), (9, "s " * 5), (9, "s " * 5)]
    sources = ["a", "a", "a", "b", "b", "b", "a", None, None]
    docs = make_docs(rows, source=sources)
    for per_bin in (1, 100):
        plan = mixing.mix(docs, rows_per_bin=per_bin).collect()
        want = sorted((str(r.doc_id), r.size, r.taken // r.size) for r in plan if r.taken)
        got = mixing.mixed_documents(docs, rows_per_bin=per_bin)
        assert got.columns == [*docs.columns, "n_words", "copies"]
        assert sorted((str(r.doc_id), len(r.text.split()), r.copies) for r in got.collect()) == want
        assert all(r.n_words == len(r.text.split()) for r in got.collect())


def test_equal_rows_may_be_taken_differently_often(make_docs):
    docs = make_docs([(1, "w w w")] * 5 + [(2, "v " * 8)], source=["a"] * 5 + ["b"])
    plan = mixing.mix(docs).collect()
    taken = sorted(r.taken // r.size for r in plan if r.doc_id == 1)
    assert len(set(taken)) > 1
    got = mixing.mixed_documents(docs).collect()
    assert sorted(r.copies for r in got if r.doc_id == 1) == [t for t in taken if t]


def test_running_sums_in_two_levels(spark):
    rows = [(p, k, (k * 7 + p) % 11) for p in range(3) for k in range(0, 300, p + 1)]
    sums = spark.createDataFrame(rows, "p long, k long, v long")
    got = {(r.p, r.k): r.s for r in mixing.before(sums, "k", "v", "s", ["p"], fan=16).collect()}
    assert got == {(p, k): sum(v for q, j, v in rows if q == p and j < k) for p, k, _ in rows}
    every = sums.filter("p = 1").drop("p")
    got = {r.k: r.s for r in mixing.before(every, "k", "v", "s", fan=16).collect()}
    assert got == {k: sum(v for p, j, v in rows if p == 1 and j < k) for p, k, _ in rows if p == 1}


def test_quality_judges_row_by_row(spark, make_docs):
    good = [(i, prose(i, 40)) for i in range(1, 120)]
    bad = [(1000 + i, prose(i, 40).upper().replace(" ", "!! ")) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = [(500, prose(500, 40)), (None, prose(501, 40)), (None, prose(501, 40)), *good]
    docs = make_docs([*kept, (500, prose(502, 40).upper().replace(" ", "!! ")), (None, prose(503, 40).upper().replace(" ", "!! ")), *bad])
    got = quality.drop_low_quality(docs, labels)
    assert left(got) == sorted(kept, key=str) and got.columns == docs.columns


def test_all_stages_on_repeated_and_missing_ids(spark, make_docs, tmp_path):
    """The stages in their order, against what each should leave of rows that share ids, have none, or have equal texts."""
    leak, texts = prose(900, 25), [prose(k, 45) for k in range(40)]
    rows = list(enumerate(texts))
    rows += [(3, "x " + leak), (None, texts[5]), (None, texts[6] + " more"), (7, texts[8]), (None, leak), (None, texts[39] + " own words of its own"), (50, None), (None, None)]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {"quality": rows}
    want["exact"] = [r for r in rows if r not in [(None, texts[5]), (8, texts[8]), (None, None)]]
    want["near"] = [r for r in want["exact"] if r not in [(None, texts[6] + " more"), (None, texts[39] + " own words of its own"), (None, leak)]]
    want["benchmark"] = [r for r in want["near"] if leak not in (r[1] or "")]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert left(held) == sorted(want[name], key=str), name
        assert held.columns == docs.columns
    mixed = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path))
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {r for r in want["benchmark"] if r[1]}
    assert all(r.n_words == len(r.text.split()) for r in mixed.collect())
    before = [r.doc_id for r in mixed.select("doc_id").collect()]
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, before)) == sorted(str(r.doc_id) for r in done.collect())
    assert len(common._made) >= 1 and done.count() == len(before)  # what the stages were made from is gone, the result is not
