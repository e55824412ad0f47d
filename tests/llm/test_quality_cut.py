"""The quality stage's cut is the quantile of all labelled rows' scores."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwise.llm import quality

WORDS = np.array("river stone market account session handler garden message customer invoice service".split())


def plain_cut(scores, y, share):
    weight = np.where(y == 1, (1 - share) / max((y == 1).sum(), 1), share / max((y == 0).sum(), 1))
    order = np.lexsort((y, scores))
    upto = np.cumsum(weight[order]) - weight[order] / 2
    return np.mean([np.interp(share * k, upto, scores[order]) for k in (0.97, 1.03)])


@pytest.mark.parametrize("share", [0.0, 0.17, 0.5, 0.98, 1.0])
def test_cut_is_the_exact_quantile(spark, monkeypatch, share):
    monkeypatch.setattr(quality, "LISTED", 3)
    rng = np.random.default_rng(int(share * 100))
    # Far outliers, so that all else is in one bin at first; scores close together; scores that many rows share.
    scores = np.concatenate([[-2e5, 3e5], rng.normal(size=700), 0.3 + rng.random(300) * 1e-9, np.repeat([-0.5, 0.1, 1.5], 100)])
    for y in (rng.integers(0, 2, len(scores)), (scores > 0.2).astype(int)):
        rows = spark.createDataFrame(list(zip(scores.tolist(), y.tolist(), strict=True)), "score double, y int")
        assert np.isclose(quality.cut_score(rows, share), plain_cut(scores, y, share), rtol=1e-12, atol=1e-12)


def test_stage_drops_the_share_that_all_labels_name(spark, make_docs, tmp_path):
    """The 300 good documents last by the id's hash look like bad ones: a cut that leaves them out drops them all."""
    rng = np.random.default_rng(12)
    ids = [i for i in range(6_000) if zlib.crc32(str(i).encode()) % 4 != 2][:4_360]
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id")).collect()]
    bad, loud = set(order[:60]), set(order[-300:])
    rows = [(i, " ".join(rng.choice(WORDS, 8)) + "!" * int(rng.integers(5, 30) if i in bad | loud else rng.integers(0, 3))) for i in ids]
    spark.createDataFrame([(i, int(i not in bad), 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, make_docs(rows), str(tmp_path)).count()
    assert abs(len(ids) - kept - len(bad)) <= 2
