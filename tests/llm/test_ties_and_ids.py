"""Equal scores around the cut of the quality stage, and rows that share an id in language-model scoring."""

import numpy as np

from tripwise.llm import ctw, quality

WORDS = "river stone market account session handler garden message customer invoice service".split()


def test_equal_texts_are_kept_or_dropped_together(spark, make_docs):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, 12)) + "!" * int(rng.integers(0, 9)) for _ in range(30)]
    rows = [(k, texts[k % 30]) for k in range(240)]
    labels = spark.createDataFrame([(k, int(texts[k % 30].count("!") < 5), 0) for k in range(240)], "doc_id long, quality int, toxic int")
    scores = {}
    for r in quality.quality_report(make_docs(rows), labels).collect():
        scores.setdefault(texts[r.doc_id % 30], set()).add((r.score, r.predicted))
    assert all(len(found) == 1 for found in scores.values())
    kept = [r.doc_id for r in quality.drop_low_quality(make_docs(rows), labels).collect()]
    times = np.bincount([k % 30 for k in kept], minlength=30)
    assert set(times) == {0, 8}


def test_rows_that_share_an_id_are_scored_apart(spark, make_docs):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(1, 15)))) for _ in range(24)]
    learns = lambda i: i % 10 != 0
    shared = [((k % 3) * 5, t) for k, t in enumerate(texts)]  # ids 0, 5 and 10
    own = [(1000 * k + (k % 3) * 5, t) for k, t in enumerate(texts)]
    rows = lambda made: sorted(tuple(r)[1:] for r in ctw.score_documents(make_docs(made), learns).collect())
    assert len(rows(shared)) == 24
    assert np.allclose(rows(shared), rows(own))
