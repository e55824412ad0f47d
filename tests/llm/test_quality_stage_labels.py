"""The pipeline's quality stage learns from every label; the ids that op6 holds out are no exception."""

import zlib

import corpus_pipeline
import numpy as np
import pytest

from tripwise.llm import quality

WORDS = np.array("river stone market account session handler garden message customer invoice service".split())


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("elsewhere", [0, 5])
def test_stage_learns_from_held_out_ids(spark, make_docs, tmp_path, elsewhere):
    """Of the documents labelled 0 all but `elsewhere` have ids that op6 does not learn from."""
    rng = np.random.default_rng(elsewhere)
    ids = range(600)
    bad = {*[i for i in ids if is_held(i)][:60], *[i for i in ids if not is_held(i)][:elsewhere]}
    rows = [(i, " ".join(rng.choice(WORDS, 8)) + "!" * int(rng.integers(5, 30) if i in bad else rng.integers(0, 3))) for i in ids]
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in ids], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = make_docs(rows)
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert len((set(ids) - kept) ^ bad) <= 3
    # op6 itself holds them out: turned round, their labels change none of its scores.
    turned = spark.createDataFrame([(i, int((i not in bad) != is_held(i)), 0) for i in ids], "doc_id long, quality int, toxic int")
    scores = [sorted(map(tuple, quality.quality_report(docs, lab).collect())) for lab in (labels, turned)]
    assert scores[0] == scores[1]
